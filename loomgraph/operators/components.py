"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import discard, saved, ship

ROUNDS = 60
#: Edges that a task turns into stars at once.
HELD = 1_000_000


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) with the same components, of fewer rows where edges are many for each node: every task links each node of HELD of its edges at a time to the smallest one that these connect it with. Null ends and loops are ignored."""
    ship(edges.sparkSession)
    kind = edges.schema[a].dataType

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield from _linked(kept)
                kept, size = [], 0
        if size:
            yield from _linked(kept)

    some = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return some.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def _linked(batches: list[pa.RecordBatch]):
    """Each node but the smallest of its component with that one."""
    ends = pa.chunked_array([x.column(i) for i in (0, 1) for x in batches]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names, place = ends.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    low, high = np.split(place[ends.indices.to_numpy()], 2)
    label = np.arange(len(names))
    while True:
        low, high = np.minimum(label[low], label[high]), np.maximum(label[low], label[high])
        apart = low != high
        if not apart.any():
            break
        low, high = low[apart], high[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    at = np.flatnonzero(label != np.arange(len(names)))
    for i in range(0, len(at), 50_000):
        some = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(label[some]))], ["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge touches; the component is its smallest node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to its smallest neighbour,
    then its smaller ones. Stars form in a logarithmic number of rounds whatever the shape. Hubs are reduced with map-side
    aggregation, and the joins leave their exchanges to the planner, so that skewed ones are split. Each round is
    written to the shared folder, which cuts lineage; the one before goes. Null ends and loops are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = saved(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        small = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        e, last = saved(small, "cc"), e
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")) if e.schema["b"].dataType.typeName() in ("long", "integer") else F.sum(F.xxhash64("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
