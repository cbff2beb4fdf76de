"""Sinks: CSV with a fixed header, GraphML, tables replaced at once, a pair's export, tables of scores by model."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def encoded(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON texts."""
    return df.select(*(F.to_json(c.name).alias(c.name) if isinstance(c.dataType, ArrayType | MapType | StructType) else F.col(c.name) for c in df.schema))


def nonempty_columns(df: DataFrame, always: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold at least one value that is neither null, blank nor none, the ones to come first first, then by name."""
    full = df.agg(*(F.max((F.col(f"`{c}`").isNotNull() & ~F.lower(F.trim(F.col(f"`{c}`").cast("string"))).isin("", "none"))).alias(c) for c in df.columns)).first()
    have = [c for c in df.columns if full[c] and c not in never]
    return [c for c in always if c in have] + sorted(c for c in have if c not in always)


def write_csv(df: DataFrame, path: str, columns: list[str], partition_by: tuple[str, ...] = ()) -> None:
    """CSV files with a header and exactly these columns; one that df lacks is empty, one that is not named is an error."""
    if extra := [c for c in df.columns if c not in columns and c not in partition_by]:
        raise ValueError(f"columns without a place: {extra}")
    out = encoded(df)
    out = out.select(*partition_by, *(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns if c not in partition_by))
    w = out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("quoteAll", False)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def _paths(spark: SparkSession, path: str):
    """(function from a text to a Hadoop path, its file system)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at, at(path).getFileSystem(conf)


def _renamed(fs, source, target) -> None:
    """Rename, or raise: a file system may tell a failure by its answer alone."""
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def replace_table(df: DataFrame, path: str) -> None:
    """Write df as Parquet beside path and put it in path's place by renaming: path holds the old table or the new one, whole, but for the moment between the two renames.

    If the new table can't take the place, the old one is put back; the old one is deleted last. A table whose readers must never wait is better kept in versions.
    """
    _swapped(df.sparkSession, path, df.write.parquet)


def _swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write make a folder beside path, then put it in path's place."""
    draft, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    at, fs = _paths(spark, path)
    write(draft)
    had = fs.exists(at(path))
    if had:
        _renamed(fs, at(path), at(old))
    try:
        _renamed(fs, at(draft), at(path))
    except Exception:
        if had:
            _renamed(fs, at(old), at(path))
        raise
    fs.delete(at(old), True)


def _xml(c: Column) -> Column:
    """A text with the characters escaped that XML gives a meaning."""
    for plain, told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(told))
    return c


def graphml_rows(nodes: DataFrame, edges: DataFrame, by: str | None = None) -> DataFrame:
    """(by, part, place, line): the lines of a GraphML document, or of one for each value of a column that both tables have; they belong in the order of part and place.

    Attributes are texts, nested ones as JSON, nulls left out. The lines are made on the executors.
    """
    n, e = encoded(nodes), encoded(edges)
    own = [by] if by else []
    node_attrs, edge_attrs = [c for c in n.columns if c not in ("node_id", *own)], [c for c in e.columns if c not in ("src", "dst", "key", *own)]
    data = lambda kind, names: F.concat_ws("", *(F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"<data key={quoteattr(f'{kind}_{c}')}>"), _xml(F.col(f"`{c}`").cast("string")), F.lit("</data>"))) for c in names))
    quoted = lambda c: F.concat(F.lit('"'), _xml(F.col(c).cast("string")), F.lit('"'))
    rows = n.select(*own, F.lit(1).alias("part"), F.col("node_id").cast("string").alias("place"), F.concat(F.lit("<node id="), quoted("node_id"), F.lit(">"), data("n", node_attrs), F.lit("</node>")).alias("line"))
    line = F.concat(F.lit("<edge id="), quoted("key"), F.lit(" source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit(">"), data("e", edge_attrs), F.lit("</edge>"))
    rows = rows.unionByName(e.select(*own, F.lit(2).alias("part"), F.concat_ws("\x01", F.col("src"), F.col("dst"), F.format_string("%020d", F.col("key").cast("long"))).alias("place"), line.alias("line")))
    keys = "".join(f'<key id={quoteattr(f"{k[0]}_{c}")} for={quoteattr(k)} attr.name={quoteattr(c)} attr.type="string"/>' for k, names in (("node", node_attrs), ("edge", edge_attrs)) for c in names)
    head = f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    frame = F.array(F.struct(F.lit(0).alias("part"), F.lit(head).alias("line")), F.struct(F.lit(3).alias("part"), F.lit("</graph></graphml>").alias("line")))
    documents = nodes.select(*own).distinct() if by else nodes.sparkSession.range(1)
    return rows.unionByName(documents.select(*own, F.explode(frame).alias("f")).select(*own, "f.part", F.lit("").alias("place"), "f.line"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML document as a folder of text files that make it up in the order of their names: no row passes through the driver."""
    graphml_rows(nodes, edges).orderBy("part", "place").select("line").write.mode("overwrite").text(path)


def _by_pair(df: DataFrame, path: str, kind: str, *order: str) -> None:
    """One file of a pair's lines in a folder of its own."""
    rows = df.repartition("pair_id").sortWithinPartitions("pair_id", *order)
    rows.select("pair_id", "line").write.mode("overwrite").partitionBy("pair_id").option("lineSep", "\n").text(f"{path}/{kind}")


def export_pairs(nodes: DataFrame, edges: DataFrame, prompts: DataFrame, path: str) -> None:
    """Explanations as files, a folder for each kind and in it one for each pair: nodes and edges as CSV, the subgraph as GraphML, the prompt as text and the chat's messages as JSON.

    nodes: pair_id, node and scores. edges: pair_id, src, dst, key and attributes. prompts: pair_id, system, prompt.
    """
    write_csv(nodes.repartition("pair_id"), f"{path}/nodes", ["pair_id", *(c for c in nodes.columns if c != "pair_id")], ("pair_id",))
    write_csv(edges.repartition("pair_id"), f"{path}/edges", ["pair_id", *(c for c in edges.columns if c != "pair_id")], ("pair_id",))
    _by_pair(graphml_rows(nodes.withColumnRenamed("node", "node_id"), edges, "pair_id"), path, "graphml", "part", "place")
    _by_pair(prompts.select("pair_id", F.col("prompt").alias("line")), path, "prompts")
    told = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    _by_pair(prompts.select("pair_id", F.to_json(told).alias("line")), path, "messages")


#: Columns of the tables of scores, in order.
SCORE_COLUMNS = [
    "gene_a", "gene_b", "model", "strategy", "f1_raw", "f1_raw_full", "f1_raw_topk_p50", "f1_raw_topk_p75", "precision_raw", "recall_raw", "grounded_score",
    "faithfulness", "gt_faithfulness", "kg_faithfulness", "hallucination_score", "total_similarity", "format_score", "citation_count",
]


def update_scores(rows: DataFrame, path: str, dry_run: bool = False) -> int:
    """Replace the table of scores at path by these rows, in the order of pair and strategy, as one CSV file; the number of rows. Without rows, or on a dry run, nothing is written."""
    n = rows.count()
    if n and not dry_run:
        ordered = rows.select(*(c for c in SCORE_COLUMNS if c in rows.columns)).orderBy("gene_a", "gene_b", "strategy").coalesce(1)  # a report: a row for each pair and strategy
        _swapped(rows.sparkSession, path, lambda draft: write_csv(ordered, draft, SCORE_COLUMNS))
    return n


def write_model_scores(rows: DataFrame, folder: str, model: str) -> list[str]:
    """The tables of a model's scores, naive answers apart; their names tell how many pairs they hold. Tables of the same model under other numbers go; without rows nothing changes."""
    spark, kept = rows.sparkSession, []
    at, fs = _paths(spark, folder)
    own = rows.filter(F.col("model") == model)
    for kind, some in (("normal", own.filter("strategy <> 'naive'")), ("naive", own.filter("strategy = 'naive'"))):
        if pairs := some.select("gene_a", "gene_b").distinct().count():
            kept.append(f"eval_{kind}_{pairs}pairs_{model}.csv")
            update_scores(some, f"{folder}/{kept[-1]}")
    if kept:
        for s in fs.listStatus(at(folder)):
            name = s.getPath().getName()
            if re.fullmatch(rf"eval_(normal|naive)_\d+pairs_{re.escape(model)}\.csv", name) and name not in kept:
                fs.delete(s.getPath(), True)
    return kept


def save_json(value: object, path: str) -> None:
    """A small JSON file on the driver, indented, in place at once."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(draft, path)
