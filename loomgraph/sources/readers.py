"""Readers: pair lists, tolerant JSON and TSV tables, effect matrices, payload folders, GraphML."""

from __future__ import annotations

import csv
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: A number as a matrix of effects writes it.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array file, with seq, their place in it."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema}>>").alias("rows"))
    return whole.select(F.posexplode("rows").alias("seq", "r")).select("seq", "r.*")


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, or an empty one where there is none; malformed records come as nulls."""
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def tsv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A TSV file with a header; missing values are empty texts."""
    df = spark.read.csv(path, sep="\t", header=True).na.fill("")
    return df if limit is None else df.limit(limit)


def _fields(line: str) -> list[str]:
    """Fields of a CSV line: quoted ones may hold commas and doubled quotes."""
    if '"' not in line:
        return line.rstrip("\r").split(",")
    return next(csv.reader([line]), [])


def effect_matrix(spark: SparkSession, path: str, cell_prefix: str = "ACH-") -> DataFrame:
    """(cell, gene, effect) of a CSV matrix whose first column is an index; it is turned if one of its first five columns is a cell. Gene names end at their first blank.

    The plan does not grow with the columns: lines are read as texts, a worker splits each once and emits the places of its numbers, and the header's names, one row for each column, are joined by place. What is no number is null. A quoted field may
    hold commas and quotes, but no line ends. Lines equal to the header, as a folder of parts has, are no rows.
    """
    ship(spark)
    lines = spark.read.text(path)
    head = lines.limit(1).collect()
    names = _fields(head[0]["value"].lstrip("\ufeff")) if head else []
    turned = any(c.upper().startswith(cell_prefix) for c in names[1:6])
    header = head[0]["value"] if head else ""

    def run(batches):
        for b in batches:
            for line in b.column(0).to_pylist():
                if line is None or line == header or not line.strip():
                    continue
                index, *values = _fields(line)
                told = pa.array(values[: len(names) - 1], pa.string())
                numbers = pc.cast(pc.if_else(pc.match_substring_regex(told, NUMBER), pc.utf8_trim_whitespace(told), None), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(index), len(numbers)), pa.array(range(1, len(numbers) + 1), pa.int32()), numbers], ["index", "place", "effect"])

    columns = spark.createDataFrame([(i, n) for i, n in enumerate(names) if i], "place int, name string")
    long = lines.mapInArrow(run, "index string, place int, effect double").join(columns, "place")
    cell, gene = ("name", "index") if turned else ("index", "name")
    return long.select(F.col(cell).alias("cell"), F.split(F.col(gene), " ")[0].alias("gene"), "effect")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the JSON files of a folder of pair folders."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: ids and ends with a map of attributes by name; type in lower case for nodes."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    data = "data array<struct<_key string, _VALUE string>>"
    names = read("key", "_id string, `_attr.name` string, _for string").select(F.struct(F.col("_id").alias("k"), F.col("`_attr.name`").alias("v")).alias("e")).agg(F.map_from_entries(F.collect_list("e")).alias("names"))  # the file's header
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.expr("cast(array() as array<struct<_key:string,_VALUE:string>>)")), lambda d: F.struct(F.coalesce(F.element_at("names", d["_key"]), d["_key"]), d["_VALUE"])))
    n = read("node", f"_id string, {data}").crossJoin(F.broadcast(names)).select(F.col("_id").alias("node_id"), attributes.alias("props"))
    e = read("edge", f"_id string, _source string, _target string, {data}").crossJoin(F.broadcast(names)).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_id").alias("key"), attributes.alias("props"))
    return n.withColumn("type", F.lower(F.trim(F.element_at("props", "type")))), e.withColumn("type", F.element_at("props", "type")).withColumn("source", F.element_at("props", "source"))


def load_json(path: str, default):
    """What a small JSON file on the driver holds, or the default where it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def interactions(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, seq) of a TSV of interactions: the columns of those names, or the first two; seq is the row's place within its file's part."""
    df = tsv(spark, path)
    source, target = (c if c in df.columns else df.columns[i] for i, c in enumerate(("source", "target")))
    return df.select(F.col(f"`{source}`").alias("source"), F.col(f"`{target}`").alias("target"), F.monotonically_increasing_id().alias("seq"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, messages) of a folder that holds a folder for each pair, with the chat's messages as JSON or the prompt as a text file; a text is the user's only message."""
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split("path", "/")
    named = whole.select(F.element_at(parts, -2).alias("id"), F.element_at(parts, -1).alias("name"), "value")
    kind = "array<struct<role string, content string>>"
    chat = named.filter("name LIKE '%.json'").select("id", F.from_json("value", kind).alias("m")).filter("m IS NOT NULL").groupBy("id").agg(F.min("m").alias("chat"))
    plain = named.filter("name LIKE '%.txt'").groupBy("id").agg(F.min("value").alias("value"))
    told = F.array(F.struct(F.lit("user").alias("role"), F.col("value").alias("content")))
    return chat.join(plain, "id", "full").select("id", F.coalesce("chat", told).alias("messages"))
