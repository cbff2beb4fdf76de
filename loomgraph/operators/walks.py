"""One more step from many frontiers at once, without a row for each walk.

Walks of two hops outnumber edges by the degree of what lies between, and most of them meet. So starts are dealt to blocks, those with a near node in common next to each other; a block gets the neighbours of each of its frontier nodes
once, as lists, whatever number of its starts has reached that node, and a task follows them start by start. What is shuffled is the frontier and, for each block, lists; walks exist in a task only, one start's at a time. In the worst case, starts
with nothing in common, the lists are as long as the walks. A start with more than WIDE walks is followed by joins instead, with the same result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import partitions, saved, ship

#: Walks of a block, about, those that a task follows from one start at most, and neighbours in a list, about.
WALKS, WIDE, LIST = 8_000_000, 32_000_000, 4096
#: Rows of a batch of results, about.
ROWS = 50_000


def followed(frontier: DataFrame, step: DataFrame, seen: DataFrame | None, *, by: tuple[str, ...] = ("start",), edge_by: tuple[str, ...] = (), score: str | None = None) -> DataFrame:
    """(by..., edge_by..., node) of the nodes that a step (a, b, edge_by...) leads to from a frontier (by..., edge_by..., node) and that neither it nor seen (the same columns), which holds what came before it, has; without seen nothing is left out.

    If the frontier has prob and the steps degree, with prob, the parent's over its degree (1 at least); the parent is the smallest by name or, with the name of a score of the steps, the smallest of those with the highest score, which comes with it. 
    Frontier and steps are read several times and should be saved.
    """
    spark, keys = frontier.sparkSession, [*by, *edge_by]
    ship(spark)
    told = "prob" in frontier.columns
    frontier = frontier.filter("node IS NOT NULL").select(*keys, "node", *(["prob"] if told else [])).distinct()
    facts = saved(step.groupBy("a", *edge_by).agg(F.count("*").alias("_n"), F.min("b").alias("_low")), "walks-degrees")
    sizes = frontier.withColumnRenamed("node", "a").join(facts, ["a", *edge_by]).groupBy(*keys).agg(F.sum("_n").alias("_walks"), F.min("_low").alias("_label"))
    sizes = saved(sizes, "walks-sizes")
    wide = sizes.filter(F.col("_walks") > WIDE)
    whole = None
    if wide.limit(1).count():
        far = wide.select(*keys)
        within = lambda df: _matched(df, far, keys, "left_semi")
        whole = _joined(within(frontier), step, None if seen is None else within(seen), by, edge_by, score)
    few = sizes.filter(F.col("_walks") <= WIDE)
    parts = few.groupBy("_label", *edge_by).agg(F.ceil(F.sum("_walks") / WALKS).cast("int").alias("_parts"))
    blocks = _matched(few, parts, ["_label", *edge_by]).select(*keys, F.xxhash64("_label", F.pmod(F.xxhash64(*by), F.col("_parts"))).alias("_block"))
    blocks = saved(blocks, "walks-blocks")
    placed = lambda df: _matched(df, blocks, keys)
    front = placed(frontier)
    asked = front.select("_block", *edge_by, F.col("node").alias("a")).distinct()
    lists = step.join(facts.select("a", *edge_by, (F.floor(F.col("_n") / LIST) + 1).alias("_lists")), ["a", *edge_by])
    more = ["degree"] if told else []
    lists = lists.groupBy("a", *edge_by, F.pmod(F.xxhash64("b"), F.col("_lists")).alias("_list")).agg(F.collect_list(F.struct("b", *([F.col(score).alias("e")] if score else []))).alias("_to"), *(F.first(c).alias(c) for c in more))
    kinds = {f.name: f.dataType for f in frontier.schema.fields}
    node, none = kinds["node"], lambda kind: F.lit(None).cast(kind)
    of_e = step.schema[score].dataType if score else T.DoubleType()

    def row(df: DataFrame, side: int, own: dict[str, Column]) -> DataFrame:
        empty = {**{c: none(kinds[c]) for c in by}, "prob": none("double"), "degree": none("double"), "names": none(T.ArrayType(node)), "scores": none(T.ArrayType(of_e))}
        return df.select("_block", *edge_by, F.lit(side).alias("side"), *(own.get(c, empty[c]).alias(c) for c in by), own["node"].alias("node"), *((own.get(c, v)).alias(c) for c, v in empty.items() if c not in by))

    said = asked.join(lists, ["a", *edge_by])
    rows = row(said, 0, {"node": F.col("a"), "names": F.col("_to.b"), **({"scores": F.col("_to.e")} if score else {}), **({"degree": F.greatest(F.col("degree"), F.lit(1)).cast("double")} if told else {})})
    rows = rows.unionByName(row(front, 1, {**{c: F.col(c) for c in by}, "node": F.col("node"), **({"prob": F.col("prob")} if told else {})}))
    if seen is not None:
        rows = rows.unionByName(row(placed(seen.select(*keys, "node").filter("node IS NOT NULL")), 2, {**{c: F.col(c) for c in by}, "node": F.col("node")}))
    out = T.StructType([T.StructField(c, kinds[c]) for c in keys] + [T.StructField("node", node)] + ([T.StructField(score, of_e)] if score else []) + ([T.StructField("prob", T.DoubleType())] if told else []))
    group, drop = ["_block", *edge_by], seen is not None

    def run(batches):
        held, now = [], None
        for batch in batches:
            t, at = pa.Table.from_batches([batch]), 0
            for i, key in enumerate(zip(*(t.column(c).to_pylist() for c in group), strict=True)):
                if key != now:
                    if now is not None:
                        held.append(t.slice(at, i - at))
                        yield from _block(pa.concat_tables(held), by, edge_by, score, told, drop)
                    held, now, at = [], key, i
            held.append(t.slice(at))
        if now is not None:
            yield from _block(pa.concat_tables(held), by, edge_by, score, told, drop)

    found = rows.repartition(partitions(spark), *group).sortWithinPartitions(*group, *by, "side").mapInArrow(run, out)
    return found if whole is None else found.unionByName(whole)


def _matched(x: DataFrame, y: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """x with the other columns of y where the keys agree, null with null."""
    other = y.select(*(F.col(c).alias(f"_of_{c}") for c in keys), *(c for c in y.columns if c not in keys))
    return x.join(other, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys)), how).drop(*(f"_of_{c}" for c in keys))


def _joined(frontier: DataFrame, step: DataFrame, seen: DataFrame | None, by: tuple[str, ...], edge_by: tuple[str, ...], score: str | None) -> DataFrame:
    """The same by joins, with a row for each walk."""
    keys, told = [*by, *edge_by], "prob" in frontier.columns
    reached = frontier.withColumnRenamed("node", "a").join(step, ["a", *edge_by]).withColumnRenamed("b", "node")
    if told:
        p = (F.col("prob") / F.greatest(F.col("degree"), F.lit(1))).alias("p")
        best = F.struct((-F.col(score)).alias("e"), "a", p) if score else F.struct("a", p)
        reached = reached.groupBy(*keys, "node").agg(F.min(best).alias("up")).select(*keys, "node", *([(-F.col("up.e")).alias(score)] if score else []), F.col("up.p").alias("prob"))
    else:
        reached = reached.select(*keys, "node").distinct()
    return reached if seen is None else reached.join(seen.select(*keys, "node").unionByName(frontier.select(*keys, "node")), [*keys, "node"], "left_anti")


def _block(t: pa.Table, by: tuple[str, ...], edge_by: tuple[str, ...], score: str | None, told: bool, drop: bool):
    """The results of one block's rows: lists of steps, frontier (side 1) and what was seen (side 2), those of a start next to each other."""
    side = t.column("side").to_numpy()
    lists, own = t.filter(pa.array(side == 0)), t.filter(pa.array(side > 0))
    if not len(lists) or not len(own):
        return
    far = lists.column("names").combine_chunks()
    near = pa.chunked_array([*lists.column("node").chunks, *own.column("node").chunks, far.flatten()]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(near.dictionary)  # numbers in the order of names
    names, place = near.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    code = place[near.indices.to_numpy()]
    source, node, to = np.split(code, [len(lists), len(lists) + len(own)])
    n, lengths = len(names), pc.list_value_length(far).to_numpy(zero_copy_only=False).astype(np.int64)
    turn = np.argsort(np.repeat(source, lengths), kind="stable")
    to = to[turn]
    first = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(source, weights=lengths, minlength=n).astype(np.int64), out=first[1:])
    if score:
        value = lists.column("scores").combine_chunks().flatten().take(pa.array(turn))
        missing = pc.is_null(value).to_numpy(zero_copy_only=False)
        key = value.to_numpy(zero_copy_only=False).astype(np.float64)
        key = np.where(missing, np.inf, np.where(np.isnan(key), -np.inf, key))  # as a minimum of what is negated has them
    if told:
        degree, prob = np.ones(n), own.column("prob").to_numpy(zero_copy_only=False).astype(np.float64)
        degree[source] = lists.column("degree").to_numpy()
    change = np.zeros(len(own), dtype=bool)
    change[0] = True
    for c in by:
        k = pc.fill_null(own.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy()
        change[1:] |= k[1:] != k[:-1]
    bounds = np.append(np.flatnonzero(change), len(own))
    front = side[side > 0] == 1
    new, parent, best = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.full(n, -np.inf)
    rows, nodes, ups, picks, size = [], [], [], [], 0

    def out() -> pa.RecordBatch:
        at = np.repeat(np.array(rows), [len(x) for x in nodes])
        columns = [own.column(c).combine_chunks().take(pa.array(at)) for c in (*by, *edge_by)] + [names.take(pa.array(np.concatenate(nodes)))]
        if score:
            columns.append(value.take(pa.array(np.concatenate(picks))))
        if told:
            columns.append(pa.array(np.concatenate(ups)))
        return pa.RecordBatch.from_arrays(columns, [*by, *edge_by, "node", *([score] if score else []), *(["prob"] if told else [])])

    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        at = np.flatnonzero(front[lo:hi]) + lo
        at = at[np.argsort(node[at], kind="stable")]
        here = node[at]
        count = first[here + 1] - first[here]
        total = int(count.sum())
        if not total:
            continue
        walk = np.repeat(first[here] - np.cumsum(count) + count, count) + np.arange(total)
        ends = to[walk]
        new[ends] = True
        if drop:
            new[node[lo:hi]] = False
        got = np.flatnonzero(new)
        new[ends] = False
        if told:
            up = np.repeat(np.arange(len(at)), count)
            if score:
                k = key[walk]
                best[ends] = -np.inf
                np.maximum.at(best, ends, k)
                top = np.flatnonzero(k == best[ends])[::-1]
            else:
                top = np.arange(total)[::-1]
            parent[ends[top]] = top  # the last to be put is the first by name
            chosen = parent[got]
            ups.append(prob[at][up[chosen]] / degree[here][up[chosen]])
            if score:
                picks.append(walk[chosen])
        rows.append(lo)
        nodes.append(got)
        size += len(got)
        if size >= ROWS:
            yield out()
            rows, nodes, ups, picks, size = [], [], [], [], 0
    if size:
        yield out()
