"""The driver's tables as a graph: adapters for the queries, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph

TYPES = ["STRING_association", "DepMap_codependency", "targets", "TF_regulates", "driver_in", "mutated_in", "in_pathway"]
TYPE_WEIGHTS = {"STRING_association": 0.8, "DepMap_codependency": 0.6, "targets": 0.9, "TF_regulates": 0.7, "driver_in": 0.85, "mutated_in": 0.5, "in_pathway": 0.75}
SOURCE_WEIGHTS = {"A": 0.9, "N": 0.6, "R": 0.3}
PRIORITY = {t: i for i, t in enumerate(TYPES)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _weights(column: Column, weights: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[column]


#: Columns of a line item that tell the unordered pair of an edge's nodes.
PAIR = ("l_partkey", "l_suppkey")


def edges(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One edge for each line item, from supplier to part or, for closed ones, back, with an attribute for every branch of the evidence score. If dealt, both directions of a pair are keyed in one task, and PAIR is kept."""
    supplier, part, there = F.concat(F.lit("supplier:"), F.col("l_suppkey")), F.concat(F.lit("part:"), F.col("l_partkey")), F.col("l_linestatus") == "O"
    told = {
        "src": F.when(there, supplier).otherwise(part), "dst": F.when(there, part).otherwise(supplier),
        "type": F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_linenumber") % 7 + 1).cast("int")), "source": F.col("l_returnflag"),
        "score": F.col("l_discount") * 10, "corr": F.col("l_tax") * 10 - 0.4, "phase": F.col("l_quantity") % 5,
        "level": F.substring(F.lit("ABCDEX"), (F.col("l_quantity") % 6 + 1).cast("int"), 1), "mutations": F.col("l_linenumber"),
        "fdr": F.when(F.col("l_linenumber") % 7 == 6, F.col("l_tax")),
    }
    values = {c: told[c] for c in ("score", "corr", "phase", "level", "mutations", "fdr")}
    evidence = scalars.evidence_score(_weights(told["source"], SOURCE_WEIGHTS), _weights(told["type"], TYPE_WEIGHTS), told["type"], **values)
    order = "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    # Edges are keyed by numbers and named after that: numbers are dealt and sorted faster than names.
    way = F.coalesce(there & (F.col("l_partkey").isNotNull() | F.col("l_suppkey").isNotNull()), F.lit(False))
    raw = read(spark, sf_dir, "lineitem").select(*order, *PAIR, "l_linestatus", "l_returnflag", "l_discount", "l_tax", F.round(evidence, 9).alias("evidence"), way.alias("_way"))
    keyed = graph.with_keys(raw.repartition(*PAIR) if dealt else raw, *order, "evidence", by=(*PAIR, "_way"))
    return keyed.select(*(c.alias(n) for n, c in told.items()), *order, *(PAIR if dealt else ()), "evidence", "key")


def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " END"


EDGES_SQL = f"""
    raw_edges AS (
        SELECT CASE l_linestatus WHEN 'O' THEN 'supplier:' || l_suppkey ELSE 'part:' || l_partkey END AS src,
            CASE l_linestatus WHEN 'O' THEN 'part:' || l_partkey ELSE 'supplier:' || l_suppkey END AS dst, {TYPES}[l_linenumber % 7 + 1] AS type, l_returnflag AS source,
            l_discount * 10 AS score, l_tax * 10 - 0.4::DOUBLE AS corr, l_quantity % 5 AS phase, substr('ABCDEX', (l_quantity % 6 + 1)::INT, 1) AS level,
            l_linenumber AS mutations, CASE WHEN l_linenumber % 7 = 6 THEN l_tax END AS fdr, l_orderkey, l_linenumber, l_quantity, l_extendedprice
        FROM lineitem
    ), scored AS (
        SELECT *, round(({_case("source", SOURCE_WEIGHTS)}) * ({_case("type", TYPE_WEIGHTS)}) * CASE type
            WHEN 'STRING_association' THEN greatest(0::DOUBLE, least(1::DOUBLE, score))
            WHEN 'DepMap_codependency' THEN greatest(0::DOUBLE, least(1::DOUBLE, abs(corr)))
            WHEN 'targets' THEN greatest(0::DOUBLE, least(1::DOUBLE, phase / 4))
            WHEN 'TF_regulates' THEN CASE level WHEN 'A' THEN 1::DOUBLE WHEN 'B' THEN 0.9::DOUBLE WHEN 'C' THEN 0.78::DOUBLE WHEN 'D' THEN 0.6::DOUBLE WHEN 'E' THEN 0.45::DOUBLE ELSE 0.7::DOUBLE END
            WHEN 'driver_in' THEN greatest(0::DOUBLE, least(1::DOUBLE, 1 - score / 0.25::DOUBLE))
            WHEN 'mutated_in' THEN greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * mutations))
            ELSE 1::DOUBLE END * coalesce(greatest(0::DOUBLE, least(1::DOUBLE, 1 - fdr / 0.25::DOUBLE)), 1::DOUBLE), 9) AS evidence
        FROM raw_edges
    ), edges AS (
        SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, evidence) - 1 AS key FROM scored
    ), both_ways AS (
        SELECT src AS a, dst AS b, 'forward' AS direction, * FROM edges UNION ALL SELECT dst, src, 'reverse', * FROM edges
    ), neighbors AS (SELECT DISTINCT a, b FROM both_ways WHERE a <> b),
    degrees AS (SELECT a AS node, count(DISTINCT (b, key)) AS degree FROM both_ways GROUP BY 1)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as genes, parts as pathways."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("node_id"), F.lit("gene").alias("type"), F.col("s_name").alias("symbol"))
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("node_id"), F.when(F.col("p_size") % 3 == 0, "pathway").when(F.col("p_size") % 3 == 1, "drug").otherwise("gene").alias("type"), F.col("p_name").alias("symbol"))
    return s.unionByName(p)


NODES_SQL = """
    nodes AS (
        SELECT 'supplier:' || s_suppkey AS node_id, 'gene' AS type, s_name AS symbol FROM supplier
        UNION ALL SELECT 'part:' || p_partkey, CASE p_size % 3 WHEN 0 THEN 'pathway' WHEN 1 THEN 'drug' ELSE 'gene' END, p_name FROM part
    )
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with the next one: the batch that pair operators answer."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    x, y = s.select(F.col("s_suppkey").alias("x")), s.select(F.col("s_suppkey").alias("y"))
    return x.join(y, F.col("y") == F.col("x") + 1).select(F.col("x").cast("long").alias("pair_id"), F.concat(F.lit("supplier:"), F.col("x")).alias("a"), F.concat(F.lit("supplier:"), F.col("y")).alias("b"))


PAIRS_SQL = """
    pairs AS (
        SELECT x.s_suppkey AS pair_id, 'supplier:' || x.s_suppkey AS a, 'supplier:' || y.s_suppkey AS b
        FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1
    )
"""
