"""Exact top-k inner products by Fagin's threshold algorithm.

Method: within a shard of candidates every dimension has a list of the candidates sorted by their component. For a query
the lists are read in parallel, each from the end that its query component favours. A candidate that turns up in any list
is scored in full; no other candidate is touched. Reading stops at the depth where the threshold, the inner product of the query with the components at the lists' depth, falls below the k-th score (equality goes on, since a tie may go
to a smaller id). A first short reading gives a k-th score, and since scores only rise, the depth at which that score stops the lists is enough: it is found by bisection, as the threshold falls with the depth, and the lists are read down to
it at once. Where that depth is so far down that the lists hold as many entries above it as there are candidates, as with vectors of many components of weak contrast, every candidate would turn up; then all of them are scored, as one matrix product
for all such queries of a batch.

Scores are exact integers: held in floating point as long as every partial sum is exact in it, in 64-bit integers up to 2^63, and in Python's integers beyond; a score among a query's best that no long can hold is an error.

Scale and skew: candidates are dealt by a hash of their ids into shards of about CANDIDATES, queries into blocks of about QUERIES. A task has a shard and a block: it holds the
shard, sorts its lists once and streams the queries past them, returning k rows for each query, and these are ranked once more.

Defined results: components beyond a long are held at its ends. A vector that is null, or holds a null or non-finite component, takes no part. Shorter vectors
count as filled up with zeros. Rows without an id take no part. Of repeated rows with one id the query is the least vector, and each row is a candidate of its own,
but never for its own id. Columns besides the id and the vector are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 20
#: Candidates and queries of a task, about, and queries bounded at once.
CANDIDATES, QUERIES, AT_ONCE = 16_384, 8_192, 64
FIRST_DEPTH = 4


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


class Lists:
    """Sorted per-dimension lists over a shard of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.up = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)  # [dimension, position]
        self.sorted = np.take_along_axis(self.vectors.T, self.up.astype(np.int64), axis=1)

    def best(self, places: np.ndarray, scores: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best k of scored candidates, the query's own id left out, ties to the smaller id; places follow ids."""
        own = self.ids[places] == query_id
        if own.any():
            places, scores = places[~own], scores[~own]
        if len(scores) > k and scores.dtype != object:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            places, scores = places[some], scores[some]
        keep = np.lexsort((places, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], places[i]))[:k], dtype=np.int64)
        return places[keep], scores[keep]

    def threshold(self, query: np.ndarray, dims: np.ndarray, depth: int):
        """The most that a candidate below the depth of all lists scores."""
        at = np.where(query[dims] > 0, len(self.ids) - depth, depth - 1)
        return self.sorted[dims, at] @ query[dims]

    def seen(self, query: np.ndarray, dims: np.ndarray, depth: int) -> np.ndarray:
        """Places of the candidates that the lists show down to the depth."""
        shown = np.zeros(len(self.ids), dtype=bool)
        shown[self.up[dims[query[dims] < 0], :depth]] = True
        shown[self.up[dims[query[dims] > 0], len(self.ids) - depth :]] = True
        return np.flatnonzero(shown)

    def read(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(places, scores, candidates scored) of the best k by the lists; None where they would show as many entries as there are candidates."""
        n, dims = len(self.ids), np.flatnonzero(query)
        if not len(dims):
            return None
        low, high = FIRST_DEPTH, n // len(dims)  # the lists may be read so far down
        new = places = np.zeros(0, dtype=np.int64)
        while len(places) < k:
            if low >= high:
                return None
            new = self.seen(query, dims, low)
            places, scores = self.best(new, self.vectors[new] @ query, query_id, k)
            first, low = low, low if len(places) >= k else 2 * low
        if not scores[-1] > self.threshold(query, dims, high):
            return None
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if scores[-1] > self.threshold(query, dims, middle) else (middle + 1, high)
        if low > first:
            more = np.setdiff1d(self.seen(query, dims, low), new, assume_unique=True)
            both = np.concatenate((places, more))
            places, scores = self.best(both, self.vectors[both] @ query, query_id, k)
            new = np.concatenate((new, more))
        return places, scores, len(new)

    def top(self, query_ids: list[int], queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, scores, candidates scored) of the best k for each query."""
        found = [self.read(i, q, k) for i, q in zip(query_ids, queries, strict=True)]
        rest = [i for i, f in enumerate(found) if f is None]
        if rest:
            every = np.arange(len(self.ids))
            for i, scores in zip(rest, queries[rest] @ self.vectors.T, strict=True):
                found[i] = (*self.best(every, scores, query_ids[i], k), len(every))
        return [(self.ids[places], scores, n) for places, scores, n in found]


def exact_type(peak: int, width: int) -> type:
    """In what a sum of width products of whole numbers up to the peak, partial sums included, is exact."""
    most = peak * peak * max(1, width)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query row against all other rows, ties to the smaller id."""
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    rows = common.saved(rows, "topk-rows")
    n, asked, width, high, low = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    kind = exact_type(max(high or 0, -(low or 0)), width or 0)
    shards, blocks = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))
    left = rows.select(F.expr(f"cast(pmod(xxhash64(vec_id, 'candidate'), {shards}) as int)").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.expr(f"cast(pmod(xxhash64(vec_id, 'query'), {blocks}) as int)").alias("block"), F.lit(True).alias("asks"), "vec_id", "v")

    def dense(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        v = b.column(4)
        flat, at = np.asarray(v.flatten(), dtype=np.int64), np.asarray(v.offsets)
        at, length = at - at[0], np.diff(at)
        out = np.zeros((len(ids), width or 0), dtype=np.int64)
        row = np.repeat(np.arange(len(ids)), length)
        out[row, np.arange(len(flat)) - np.repeat(at[:-1], length)] = flat
        return ids, out.astype(kind)

    def find(batches):
        now, held, lists = None, [], None
        for whole in batches:
            keys = np.stack([np.asarray(whole.column(0)), np.asarray(whole.column(1)), whole.column(2).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                shard, block, asks = keys[lo].tolist()
                if now != (shard, block):
                    now, held, lists = (shard, block), [], None
                ids, v = dense(whole.slice(lo, hi - lo))
                if not asks:
                    held.append((ids, v))
                    continue
                if lists is None and held:
                    lists = Lists(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
                    held = []
                if lists is None:
                    continue
                for at in range(0, len(ids), AT_ONCE):
                    found = lists.top(ids[at : at + AT_ONCE].tolist(), v[at : at + AT_ONCE], k)
                    scores = np.concatenate([x for _, x, _ in found])
                    if kind is object and any(abs(x) >= 1 << 63 for x in scores):
                        raise OverflowError("an inner product beyond a long")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[at : at + AT_ONCE], [len(i) for i, _, _ in found]), pa.int64()), pa.array(np.concatenate([i for i, _, _ in found]), pa.int64()), pa.array(scores.astype(np.int64), pa.int64())],
                        ["query_id", "vec_id", "score"],
                    )

    both = left.unionByName(right).repartition(min(shards * blocks, 4 * common.partitions(spark)), "shard", "block").sortWithinPartitions("shard", "block", "asks")
    found = both.mapInArrow(find, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
