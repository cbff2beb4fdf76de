"""Queries of the paired statistics: return flags as strategies, order lines' measures as metrics, orders as items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from . import harness as h
from .registry import query

_ROWS = """
    m AS (SELECT l_orderkey AS item, l_returnflag AS strategy, round(avg(l_quantity), 9) AS quantity, round(avg(l_extendedprice), 9) AS price, round(avg(l_discount), 9) AS hallucination_discount, round(avg(l_tax), 9) AS tax FROM lineitem GROUP BY 1, 2),
    r AS (UNPIVOT m ON quantity, price, hallucination_discount, tax INTO NAME metric VALUE value),
    paired AS (SELECT b.item, b.metric, b.value AS base, o.value AS other, o.value - b.value AS delta FROM r b JOIN r o ON b.item = o.item AND b.metric = o.metric AND b.strategy = 'A' AND o.strategy = 'R')
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = h.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("strategy")).agg(
        *(F.round(F.avg(c), 9).alias(n) for c, n in (("l_quantity", "quantity"), ("l_extendedprice", "price"), ("l_discount", "hallucination_discount"), ("l_tax", "tax")))
    )
    return m.unpivot(["item", "strategy"], ["quantity", "price", "hallucination_discount", "tax"], "metric", "value")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired(_rows(spark, sf_dir), "A", "R")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {_ROWS} SELECT metric, strategy, round(avg(value), 6) AS mean, count(value) AS n FROM r GROUP BY 1, 2")
def strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.summary(_rows(spark, sf_dir)), "mean")


@query(f"""WITH {_ROWS} SELECT metric, round(avg(value) FILTER (strategy = 'A'), 6) AS "A", round(avg(value) FILTER (strategy = 'N'), 6) AS "N", round(avg(value) FILTER (strategy = 'R'), 6) AS "R" FROM r GROUP BY 1""")
def strategy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.summary_table(_rows(spark, sf_dir), ["A", "N", "R"]), "A", "N", "R")


@query(f"WITH {_ROWS} SELECT item, metric, round(base, 6) AS base, round(other, 6) AS other, round(delta, 6) AS delta FROM paired")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pairs(spark, sf_dir), "base", "other", "delta")


@query(f"WITH {_ROWS}, a AS (SELECT metric, avg(base) AS b, avg(other) AS o FROM paired GROUP BY 1) SELECT metric, round(b, 4) AS base_mean, round(o, 4) AS other_mean, round(o - b, 4) AS delta, printf('%+.1f%%', CASE WHEN b = 0 THEN 0::DOUBLE ELSE (o - b) / b * 100 END) AS change FROM a")
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.changes(_pairs(spark, sf_dir))


@query(f"WITH {_ROWS}, a AS (SELECT item, avg(base) AS b, avg(other) AS o FROM paired GROUP BY 1) SELECT item, round(b, 6) AS base_avg, round(o, 6) AS other_avg, round(o - b, 6) AS delta, CASE WHEN b > o THEN 'base' ELSE 'other' END AS winner FROM a")
def per_item_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.per_item(_pairs(spark, sf_dir)), "base_avg", "other_avg", "delta")


_BETTER = "CASE WHEN metric LIKE '%hallucination%' THEN {a} < {b} ELSE {a} > {b} END"


@query(f"WITH {_ROWS} SELECT metric, round(count(*) FILTER ({_BETTER.format(a='other', b='base')}) * 100::DOUBLE / count(*), 6) AS win, round(count(*) FILTER ({_BETTER.format(a='base', b='other')}) * 100::DOUBLE / count(*), 6) AS loss, round(count(*) FILTER (other = base) * 100::DOUBLE / count(*), 6) AS tie FROM paired GROUP BY 1")
def win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.win_loss(_pairs(spark, sf_dir)), "win", "loss", "tie")


@query(f"WITH {_ROWS}, s AS (SELECT metric, avg(base) AS mb, avg(other) AS mo, var_samp(base) AS vb, var_samp(other) AS vo, count(*) AS n FROM paired GROUP BY 1) SELECT metric, round((mo - mb) / sqrt(((n - 1) * vb + (n - 1) * vo) / (2 * n - 2)), 6) AS d FROM s WHERE n >= 2 AND vb + vo > 0")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.cohens_d(_pairs(spark, sf_dir)), "d")


@query(f"WITH {_ROWS}, n AS (SELECT * FROM r WHERE strategy = 'N') SELECT x.metric AS x, y.metric AS y, round(corr(x.value, y.value), 6) AS r FROM n x JOIN n y USING (item) GROUP BY 1, 2")
def metric_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.correlations(_rows(spark, sf_dir).filter("strategy = 'N'")), "r")


@query(f"""
    WITH {_ROWS}, q AS (SELECT metric, quantile_cont(delta, 0.25) AS q1, quantile_cont(delta, 0.75) AS q3, count(*) AS n, max(delta) - min(delta) AS range FROM paired GROUP BY 1)
    SELECT item, p.metric, round(delta, 6) AS delta FROM paired p JOIN q ON p.metric = q.metric WHERE n >= 4 AND range > 0 AND q3 > q1 AND (delta < q1 - 1.5::DOUBLE * (q3 - q1) OR delta > q3 + 1.5::DOUBLE * (q3 - q1))
""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.iqr_outliers(_pairs(spark, sf_dir)), "delta")


@query(f"""
    WITH {_ROWS} SELECT o.metric, o.strategy, round(avg(CASE WHEN o.metric LIKE '%hallucination%' THEN -1 ELSE 1 END * (o.value - b.value)), 6) AS improvement, count(*) AS n
    FROM r o JOIN r b ON o.item = b.item AND o.metric = b.metric AND b.strategy = 'A' AND o.strategy <> 'A' GROUP BY 1, 2
""")
def ablation_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.ablation_improvement(_rows(spark, sf_dir), "A"), "improvement")


@query(f"WITH {_ROWS} SELECT o.metric, o.strategy, round(avg((CASE WHEN o.metric LIKE '%hallucination%' THEN o.value < b.value ELSE o.value > b.value END)::INT), 6) AS winrate FROM r o JOIN r b ON o.item = b.item AND o.metric = b.metric AND b.strategy = 'A' AND o.strategy <> 'A' GROUP BY 1, 2")
def ablation_winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.ablation_winrate(_rows(spark, sf_dir), "A"), "winrate")


@query(f"""
    WITH {_ROWS}, e AS (SELECT item, delta, row_number() OVER (ORDER BY delta, item) AS place, row_number() OVER (ORDER BY delta DESC, item DESC) AS high, count(*) OVER () AS n FROM paired WHERE metric = 'price')
    SELECT item, round(delta, 6) AS delta, place::INT AS place FROM e WHERE n <= 20 OR place <= 10 OR high <= 10
""")
def effect_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.effect_bars(_pairs(spark, sf_dir), "price", 20), "delta")


@query(f"WITH {_ROWS}, a AS (SELECT item, avg(base) AS b, avg(other) AS o FROM paired GROUP BY 1) SELECT item, round(greatest(b, o), 6) AS best FROM a ORDER BY greatest(b, o) DESC, item LIMIT 25")
def ranking_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.ranking_bars(_pairs(spark, sf_dir), 25).select("item", "best"), "best")


@query(f"WITH {_ROWS} SELECT metric, strategy, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM r GROUP BY 1, 2")
def metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.distribution(_rows(spark, sf_dir)), "mean", "low", "q1", "median", "q3", "high")


@query(f"WITH {_ROWS} SELECT metric, strategy, round(avg(value), 6) AS mean FROM r GROUP BY 1, 2")
def radar_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.radar(_rows(spark, sf_dir)), "mean")


@query("SELECT event_type AS strategy, (row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type))::INT AS place FROM (SELECT DISTINCT event_type FROM events)")
def strategies_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.present_strategies(h.read(spark, sf_dir, "events").select(F.col("event_type").alias("strategy")), ["view", "click"])


@query("SELECT l_orderkey, 'normal' AS strategy, l_quantity AS value FROM lineitem UNION ALL SELECT o_orderkey, 'naive', o_totalprice FROM orders")
def long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = h.read(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("normal").alias("strategy"), F.col("l_quantity").alias("value"))
    b = h.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("value"))
    return stats.long_form(a, b)
