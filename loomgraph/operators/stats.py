"""Paired statistics of metrics between strategies, in long form: item, strategy, metric, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import higher_is_better
from ..runtime import saved


def paired(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(item, metric, base, other, delta) of the items that both strategies have a value for."""
    v = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    b = v.filter(F.col("strategy") == base).select("item", "metric", F.col("value").alias("base"))
    o = v.filter(F.col("strategy") == other).select("item", "metric", F.col("value").alias("other"))
    return b.join(o, ["item", "metric"]).withColumn("delta", F.col("other") - F.col("base"))


def summary(rows: DataFrame) -> DataFrame:
    """(metric, strategy, mean, n)."""
    return rows.groupBy("metric", "strategy").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def summary_table(rows: DataFrame, strategies: list[str]) -> DataFrame:
    """Means as a table: a row for each metric, a column for each strategy."""
    return rows.groupBy("metric").pivot("strategy", strategies).agg(F.avg("value"))


def changes(pairs: DataFrame) -> DataFrame:
    """(metric, base_mean, other_mean, delta, change): means, their difference and it as a percentage, 0 where the base is 0."""
    m = pairs.groupBy("metric").agg(F.avg("base").alias("b"), F.avg("other").alias("o"))
    percent = F.when(F.col("b") == 0, F.lit(0.0)).otherwise((F.col("o") - F.col("b")) / F.col("b") * 100)
    return m.select("metric", F.round("b", 4).alias("base_mean"), F.round("o", 4).alias("other_mean"), F.round(F.col("o") - F.col("b"), 4).alias("delta"), F.format_string("%+.1f%%", percent).alias("change"))


def per_item(pairs: DataFrame) -> DataFrame:
    """(item, base_avg, other_avg, delta, winner) over an item's metrics; the winner is other unless base is higher. Directions are not regarded."""
    m = pairs.groupBy("item").agg(F.avg("base").alias("base_avg"), F.avg("other").alias("other_avg"))
    return m.select("item", "base_avg", "other_avg", (F.col("other_avg") - F.col("base_avg")).alias("delta"), F.when(F.col("base_avg") > F.col("other_avg"), "base").otherwise("other").alias("winner"))


def _better(x: Column, y: Column) -> Column:
    return F.when(higher_is_better(F.col("metric")), x > y).otherwise(x < y)


def win_loss(pairs: DataFrame) -> DataFrame:
    """(metric, win, loss, tie): percentages of items on which other is better, worse, equal, by the metric's direction."""
    share = lambda c: F.count_if(c) * 100.0 / F.count("*")
    o, b = F.col("other"), F.col("base")
    return pairs.groupBy("metric").agg(share(_better(o, b)).alias("win"), share(_better(b, o)).alias("loss"), share(o == b).alias("tie"))


def cohens_d(pairs: DataFrame) -> DataFrame:
    """(metric, d): difference of means over the pooled deviation; metrics with fewer than two items or without deviation are left out."""
    s = pairs.groupBy("metric").agg(F.avg("base").alias("mb"), F.avg("other").alias("mo"), F.var_samp("base").alias("vb"), F.var_samp("other").alias("vo"), F.count("*").alias("n"))
    pooled = F.sqrt(((F.col("n") - 1) * F.col("vb") + (F.col("n") - 1) * F.col("vo")) / (2 * F.col("n") - 2))
    return s.filter("n >= 2").withColumn("p", pooled).filter("p > 0").select("metric", ((F.col("mo") - F.col("mb")) / F.col("p")).alias("d"))


def correlations(rows: DataFrame) -> DataFrame:
    """(x, y, r): Pearson correlation of every two metrics of one strategy over the items that have both."""
    a = rows.select("item", F.col("metric").alias("x"), F.col("value").alias("vx"))
    b = rows.select("item", F.col("metric").alias("y"), F.col("value").alias("vy"))
    return a.join(b, "item").groupBy("x", "y").agg(F.corr("vx", "vy").alias("r"))


def iqr_outliers(pairs: DataFrame) -> DataFrame:
    """(item, metric, delta) outside 1.5 interquartile ranges, for metrics of at least four items whose deltas vary."""
    q = pairs.groupBy("metric").agg(F.percentile("delta", 0.25).alias("q1"), F.percentile("delta", 0.75).alias("q3"), F.count("*").alias("n"), (F.max("delta") - F.min("delta")).alias("range"))
    q = q.filter("n >= 4 AND range > 0 AND q3 > q1").select("metric", "q1", "q3")
    return pairs.join(q, "metric").filter("delta < q1 - 1.5 * (q3 - q1) OR delta > q3 + 1.5 * (q3 - q1)").select("item", "metric", "delta")


def ablation_improvement(rows: DataFrame, base: str) -> DataFrame:
    """(metric, strategy, improvement, n): mean difference to the base over common items, positive where better."""
    b = rows.filter((F.col("strategy") == base) & F.col("value").isNotNull()).select("item", "metric", F.col("value").alias("b"))
    both = rows.filter((F.col("strategy") != base) & F.col("value").isNotNull()).join(b, ["item", "metric"])
    sign = F.when(higher_is_better(F.col("metric")), 1.0).otherwise(-1.0)
    return both.groupBy("metric", "strategy").agg(F.avg(sign * (F.col("value") - F.col("b"))).alias("improvement"), F.count("*").alias("n"))


def ablation_winrate(rows: DataFrame, base: str) -> DataFrame:
    """(metric, strategy, winrate): share of common items on which a strategy is better than the base; a tie is no win."""
    b = rows.filter((F.col("strategy") == base) & F.col("value").isNotNull()).select("item", "metric", F.col("value").alias("b"))
    both = rows.filter((F.col("strategy") != base) & F.col("value").isNotNull()).join(b, ["item", "metric"])
    return both.groupBy("metric", "strategy").agg(F.avg(_better(F.col("value"), F.col("b")).cast("double")).alias("winrate"))


def effect_bars(pairs: DataFrame, metric: str, top: int) -> DataFrame:
    """(item, delta, place): the deltas of a metric from lowest to highest, of more than top the lowest and highest half each."""
    d = saved(pairs.filter(F.col("metric") == metric).select("item", "delta"), "effects")
    n, half = d.count(), top // 2
    up, down = [F.col("delta").asc(), F.col("item").asc()], [F.col("delta").desc(), F.col("item").desc()]
    # Windows of at most top rows.
    first = lambda order, k: d.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    if n <= top:
        return first(up, top)
    return first(up, half).unionByName(first(down, half).withColumn("place", (F.lit(n + 1) - F.col("place")).cast("int")))


def ranking_bars(pairs: DataFrame, top: int) -> DataFrame:
    """The top items by the higher of their two averages."""
    return per_item(pairs).withColumn("best", F.greatest("base_avg", "other_avg")).orderBy(F.desc("best"), "item").limit(top)


def distribution(rows: DataFrame) -> DataFrame:
    """(metric, strategy, n, mean, low, q1, median, q3, high): what box, violin and density plots are drawn from."""
    return rows.filter("value IS NOT NULL").groupBy("metric", "strategy").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.75).alias("q3"), F.max("value").alias("high")
    )


def radar(rows: DataFrame, least: int = 3) -> DataFrame:
    """(metric, strategy, mean), refused below three metrics."""
    n = rows.select("metric").distinct().count()
    if n < least:
        raise ValueError(f"a radar needs {least} metrics, not {n}")
    return rows.groupBy("metric", "strategy").agg(F.avg("value").alias("mean"))


def present_strategies(rows: DataFrame, preferred: list[str]) -> DataFrame:
    """(strategy, place): strategies in the preferred order, then by name."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("strategy")), F.lit(0)), F.lit(len(preferred) + 1))
    return rows.select("strategy").distinct().withColumn("place", F.row_number().over(Window.orderBy(at, "strategy")))  # one row for each strategy


def long_form(normal: DataFrame, naive: DataFrame | None) -> DataFrame:
    """Rows of both tables; those of the second are of strategy naive."""
    return normal if naive is None else normal.unionByName(naive.withColumn("strategy", F.lit("naive")), allowMissingColumns=True)
