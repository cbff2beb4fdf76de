"""Personalised PageRank for many sources at once, and counterfactual necessity of nodes.

Rank leaves a node along its outgoing edges; from nodes without any it returns to the seed, as does 1 - alpha of all. So the rank from seed s is row s of G = (I - alpha P)^-1, scaled to sum 1, with P's rows of such nodes empty. Whatever
way a row is found, its residual r = e_s - (I - alpha P)' x bounds its error: |x - row| <= |r| / (1 - alpha) in the sum of absolute values. Every seed is solved until |r| <= RESIDUAL, whatever the size of the graph, so ranks are within
2 RESIDUAL / (1 - alpha) of the exact ones and do not depend on how they were found.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import discard, partitions, saved, scratch, ship
from .components import connected_components, stars

ALPHA = 0.85
#: What the residual of a seed sums to at most.
RESIDUAL = 1e-13
#: Rounds between two cuts of the lineage.
CUT = 8
#: Distinct steps up to which a task reads the whole graph from the shared folder, some 40 bytes a step, instead of joining residuals to steps in every round. The choice is of a plan and not of a result.
HELD = 2_000_000
#: Numbers that a task of necessity multiplies at once: a pair's steps times the nodes whose removal it solves.
CELLS = 2_000_000
#: Nodes that may be left to a dense inverse when nodes without steps among themselves are taken out of a held graph, and products of two steps through those taken out; graphs with more are solved by conjugate gradients.
DENSE, THROUGH = 2_048, 100_000_000
#: Shares of necessity below this are rounding.
NOTHING = 1e-9


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, w): the share of a node's outgoing edges, parallel ones counted, that lead to dst."""
    to = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return to.join(edges.groupBy("src").agg(F.count("*").alias("out")), "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w"))


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, *, alpha: float = ALPHA, rounds: int | None = None, at: DataFrame | None = None) -> DataFrame:
    """(source_id, node, rank) of every node that a seed (source_id, node) reaches along edges; others have rank 0. With at (source_id, node), of those nodes only.

    Solved to RESIDUAL, or, if rounds are given, after that many rounds of passing rank on. Only reached nodes have rows.
    """
    step = saved(transitions(edges), "ppr-steps")
    start = seeds.select("source_id", F.col("node").alias("seed")).distinct()
    if step.count() <= HELD:
        return _in_tasks(step._saved_at, step, start.select(F.lit("").alias("part"), "source_id", "seed"), alpha, rounds, at)
    parts, rest, step, start = _parts(step, start)
    found = _in_tasks(parts, step, start.filter("part IS NOT NULL"), alpha, rounds, at)
    if rest is None:
        return found
    start = start.filter("part IS NULL").drop("part")
    whole = _joined(rest, start, alpha) if rounds is None else _rounds(rest, start, alpha, rounds)
    return found.unionByName(whole if at is None else whole.join(at.select("source_id", "node").distinct(), ["source_id", "node"], "left_semi"))


def _parts(step: DataFrame, start: DataFrame) -> tuple[str, DataFrame | None, DataFrame, DataFrame]:
    """(folder, rest, steps, seeds) of a graph beyond HELD: rank never leaves a seed's connected component, so components of at most HELD steps are packed into parts of about that size, each in a folder of its own for the tasks of its seeds.

    The rest are the steps of larger components, None without any. Seeds have the name of their part: null in larger components, empty where no edge touches them.
    """
    spark = step.sparkSession
    placed = saved(connected_components(stars(step, "src", "dst")), "ppr-components")
    loops = step.filter("src = dst").select(F.col("src").alias("node")).join(placed, "node", "left_anti")
    placed = placed.unionByName(loops.select("node", F.col("node").alias("component")))
    inside = step.join(placed.withColumnRenamed("node", "src"), "src")
    size = saved(inside.groupBy("component").agg(F.count("*").alias("m")), "ppr-sizes")
    # Components meet in buckets of about a quarter of HELD by their hashes; one that is as large by itself has its own.
    fits = size.filter(F.col("m") <= HELD)
    total = fits.agg(F.sum("m")).first()[0] or 0
    alone = F.col("m") * 4 > HELD
    buckets = max(1, -(-4 * total // max(1, HELD)))
    part = F.when(alone, F.concat(F.lit("c"), F.sha2(F.col("component").cast("string"), 256))).otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("string")))
    names = saved(size.select("component", F.when(F.col("m") <= HELD, part).alias("part")), "ppr-names")
    told = inside.join(names, "component").select("src", "dst", "w", "part")
    folder = scratch(spark, "ppr-parts")
    told.filter("part IS NOT NULL").repartition("part").write.partitionBy("part").parquet(folder)
    large = size.filter(F.col("m") > HELD).limit(1).count()
    rest = saved(told.filter("part IS NULL").drop("part"), "ppr-rest-steps") if large else None
    seeds = start.join(placed.withColumnRenamed("node", "seed"), "seed", "left").join(names.withColumn("known", F.lit(True)), "component", "left")
    return folder, rest, step, saved(seeds.select(F.when(F.col("known").isNull(), "").otherwise(F.col("part")).alias("part"), "source_id", "seed"), "ppr-seeds")


def _rounds(step: DataFrame, start: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """Rank after a number of rounds."""
    home = start.select("source_id", "seed", F.col("seed").alias("node"), F.lit(1 - alpha).alias("rank"))
    rank = home.withColumn("rank", F.lit(1.0))
    for done in range(1, rounds + 1):
        moved = rank.join(step, rank["node"] == step["src"], "left")
        sent = moved.select("source_id", "seed", F.coalesce("dst", "seed").alias("node"), (alpha * F.col("rank") * F.coalesce("w", F.lit(1.0))).alias("rank"))
        rank = sent.unionByName(home).groupBy("source_id", "seed", "node").agg(F.sum("rank").alias("rank"))
        if done % CUT == 0 and done < rounds:
            rank = saved(rank, "ppr")
    return rank.select("source_id", "node", "rank")


def _joined(step: DataFrame, start: DataFrame, alpha: float) -> DataFrame:
    """The ranks of a graph of any size: residuals are pushed along all steps in every round and what was pushed is added up. A seed leaves the rounds once its residual is small enough; residuals shrink by alpha or more, so that takes
    some 180 rounds at most."""
    rest, done = start.select("source_id", F.col("seed").alias("node"), F.lit(1.0).alias("r")), None
    total = rest
    while True:
        for _ in range(CUT):
            rest = rest.join(step, rest["node"] == step["src"]).groupBy("source_id", "dst").agg(F.sum(alpha * F.col("r") * F.col("w")).alias("r")).select("source_id", F.col("dst").alias("node"), "r")
            rest = saved(rest, "ppr-rest")
            total = total.unionByName(rest)
        before, total = done, saved(total.groupBy("source_id", "node").agg(F.sum("r").alias("r")), "ppr-total")
        open_ = saved(rest.groupBy("source_id").agg(F.sum("r").alias("left")).filter(F.col("left") > RESIDUAL).select("source_id"), "ppr-open")
        done = total
        if before is not None:
            discard(before)
        if not open_.count():
            break
        rest = rest.join(open_, "source_id", "left_semi")
    return done.join(done.groupBy("source_id").agg(F.sum("r").alias("whole")), "source_id").select("source_id", "node", (F.col("r") / F.col("whole")).alias("rank"))


def solve(apply, b: np.ndarray, alpha: float = ALPHA, residual: float = RESIDUAL) -> np.ndarray:
    """x = b + apply(x) for the columns of b, where apply keeps what is not negative and takes at least 1 - alpha of every column's sum away: stabilised bi-conjugate gradients first, and rounds x + r until every column's residual sums to no
    more than wanted or rounding ends it."""
    x, r = b.copy(), apply(b)
    shadow, p, v = r.copy(), np.zeros_like(b), np.zeros_like(b)
    rho, a, w = (np.ones(b.shape[1]) for _ in range(3))
    best, kept = np.abs(r).sum(axis=0), x.copy()
    with np.errstate(all="ignore"):
        for _ in range(40):
            if (best <= residual).all():
                break
            new = (shadow * r).sum(axis=0)
            p = r + new / rho * (a / w) * (p - w * v)
            rho, v = new, p - apply(p)
            a = rho / (shadow * v).sum(axis=0)
            s = r - a * v
            t = s - apply(s)
            w = (t * s).sum(axis=0) / (t * t).sum(axis=0)
            x, r = x + a * p + w * s, s - w * t
            size = np.abs(r).sum(axis=0)
            good = np.isfinite(size) & (size < best)
            best, kept = np.where(good, size, best), np.where(good, x, kept)
            if not good.any():
                break
    x, last = kept, None
    while True:
        r = b + apply(x) - x
        size = np.abs(r).sum(axis=0)
        # A round takes 1 - alpha of a residual away, unless it is rounding.
        if (size <= residual).all() or last is not None and not (size < (1 + alpha) / 2 * last)[size > residual].any():
            return np.where(x != 0, np.maximum(x, 1e-300), 0.0)  # what is reached stays so, however little it has
        x, last = x + r, size


def eliminated(src: np.ndarray, w: np.ndarray, first: np.ndarray, targets: np.ndarray, n: int, alpha: float):
    """x of one seed's node, (I - alpha P)' x = e, by elimination: nodes no two of which share a step (f) are taken out, and what is left (h) is a dense matrix whose inverse serves every seed. None if that would have more than DENSE nodes.

    Among the rest, M = alpha P'hh + alpha^2 P'hf P'fh; I - M is strictly dominated by its diagonal in every column, so its factors need no exchange of rows, keep what nothing leads to at zero and what something leads to positive.
    """
    dst = np.repeat(targets, np.diff(np.r_[first, len(src)]))
    outer = independent(src, dst, n)
    hubs = np.flatnonzero(~outer)
    m = len(hubs)
    if not 0 < m <= DENSE:
        return None
    number = np.cumsum(~outer) - 1
    into, out, among = outer[dst], outer[src], ~outer[src] & ~outer[dst]
    h_in, f_in, w_in = number[src[into]], dst[into], alpha * w[into]  # from hubs, sorted by target
    f_out, h_out, w_out = src[out], number[dst[out]], alpha * w[out]  # to hubs
    order = np.argsort(f_out, kind="stable")
    f_out, h_out, w_out = f_out[order], h_out[order], w_out[order]
    left, right = np.searchsorted(f_out, f_in), np.searchsorted(f_out, f_in, side="right")
    count = right - left
    if count.sum() > THROUGH:
        return None
    matrix = np.zeros(m * m)
    matrix -= np.bincount(number[dst[among]] * m + number[src[among]], alpha * w[among], m * m)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(f_in):  # products of two steps, some millions at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
        size = count[lo:hi]
        first_step = np.repeat(np.arange(lo, hi), size)
        second = np.arange(len(first_step)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left[lo:hi], size)
        matrix -= np.bincount(h_out[second] * m + h_in[first_step], w_in[first_step] * w_out[second], m * m)
        lo = hi
    matrix = matrix.reshape(m, m)
    matrix[np.arange(m), np.arange(m)] += 1
    inverse = np.ascontiguousarray(np.linalg.inv(matrix).T)  # a row for each hub that rank starts from
    edge = np.flatnonzero(np.r_[True, f_in[1:] != f_in[:-1]]) if len(f_in) else np.zeros(0, dtype=np.int64)
    reached = f_in[edge]

    def solved(at: int) -> np.ndarray:
        x = np.zeros(n)
        if outer[at]:
            own = slice(*np.searchsorted(f_out, [at, at + 1]))
            near = w_out[own] @ inverse[h_out[own]]
        else:
            near = inverse[number[at]]
        x[hubs] = near
        if len(edge):
            x[reached] = np.add.reduceat(near[h_in] * w_in, edge)
        x[at] += outer[at]
        return x

    return solved


def independent(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Which nodes to take out: no two share a step, nor does one lead to itself. Nodes of few steps are taken first, each one that has fewer than all its open neighbours, until none is open."""
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(np.bincount(src, minlength=n) + np.bincount(dst, minlength=n), kind="stable")] = np.arange(n)
    taken, open_ = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
    open_[src[src == dst]] = False
    a, b = np.r_[src, dst], np.r_[dst, src]
    while open_.any():
        both = open_[a] & open_[b]
        a, b = a[both], b[both]
        least = open_.copy()
        least[a[rank[a] > rank[b]]] = False
        taken |= least
        open_ &= ~least
        open_[b[least[a]]] = False
    return taken


@lru_cache(maxsize=1)
def _graph(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(sources, weights, first steps of targets, targets, names) of the steps in a shared folder, sorted by target."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    t = pq.read_table(at, filesystem=system)
    ends = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks], t["src"].type).combine_chunks().dictionary_encode()
    codes = ends.indices.to_numpy()
    src, dst = codes[: len(t)], codes[len(t) :]
    order = np.argsort(dst, kind="stable")
    first = np.flatnonzero(np.r_[True, dst[order][1:] != dst[order][:-1]]) if len(t) else np.zeros(0, dtype=np.int64)
    return src[order], t["w"].to_numpy()[order], first, dst[order][first], ends.dictionary


def _in_tasks(folder: str, step: DataFrame, start: DataFrame, alpha: float, rounds: int | None, wanted: DataFrame | None) -> DataFrame:
    """The ranks over graphs that a task can hold; they come from the shared folder, one at a time for each worker, and not through the driver. Seeds (part, source_id, seed) are dealt to tasks, those of a part next to each other; the empty
    part is the folder itself."""
    spark = step.sparkSession
    ship(spark)
    few, whole = wanted is not None, folder == getattr(step, "_saved_at", None)

    def run(batches):
        held = at_part = None

        def of(part: str):
            """The graph of a part and what passes rank along it."""
            if not part and not whole:  # no edge touches these seeds
                return None
            src, w, first, targets, names = _graph(f"{folder}/part={part}" if part else folder)
            n, sink = len(names), np.ones(len(names), dtype=bool)
            sink[src] = False

            def pushed(x: np.ndarray) -> np.ndarray:
                out = np.zeros_like(x)
                if len(first):
                    out[targets] = alpha * np.add.reduceat(x[src, 0] * w, first)[:, None]
                return out

            return n, sink, names, pushed, eliminated(src, w, first, targets, n, alpha) if rounds is None else None

        for batch in batches:
            places = None
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != at_part:
                    held, at_part, places = of(part), part, None
                if held and places is None:
                    places = pc.index_in(batch.column(2), value_set=held[2])
                seed = batch.column(2).slice(i, 1)
                at = places[i].as_py() if held else None
                asked = batch.column(3)[i].values if few else None
                if at is None:  # no edge touches the seed: all rank stays there
                    if not few or seed[0].as_py() in asked.to_pylist():
                        yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), seed, pa.array([1.0])], ["source_id", "node", "rank"])
                    continue
                n, sink, names, pushed, direct = held
                home = np.zeros((n, 1))
                home[at] = 1
                if rounds is None:
                    x = direct(at)[:, None] if direct else None
                    if x is None or not np.abs(home + pushed(x) - x).sum() <= RESIDUAL:
                        x = solve(pushed, home, alpha)
                    x = x[:, 0] / x.sum()
                else:
                    x = home
                    for _ in range(rounds):
                        x = pushed(x) + (alpha * x[sink].sum() + 1 - alpha) * home
                    x = x[:, 0]
                some = pc.index_in(asked, value_set=names).drop_null().to_numpy().astype(np.int64) if few else np.flatnonzero(x)
                some = some[x[some] != 0]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(1)[i], len(some)), names.take(pa.array(some)), pa.array(x[some])], ["source_id", "node", "rank"])

    kind = step.schema["src"].dataType
    out = T.StructType([T.StructField("source_id", start.schema["source_id"].dataType), T.StructField("node", kind), T.StructField("rank", T.DoubleType())])
    asking = start.select("part", "source_id", F.col("seed").cast(kind))
    if few:
        asking = asking.join(wanted.groupBy("source_id").agg(F.collect_set(F.col("node").cast(kind)).alias("asked")), "source_id").select("part", "source_id", "seed", "asked")
    dealt = asking.repartition(partitions(spark)) if whole else asking.repartitionByRange(4 * partitions(spark), "part", F.xxhash64("seed")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, out)


def uniform_pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(node_id, rank): PageRank with uniform teleport over the nodes, solved to RESIDUAL; what dangles is shared by all nodes as the teleport is. Edges are between the nodes."""
    step, all_ = saved(transitions(edges), "pagerank-steps"), saved(nodes.select("node_id").distinct(), "pagerank-nodes")
    n = max(1, all_.count())
    if max(n, step.count()) > HELD:
        return _uniform_by_parts(step, all_, n, alpha)
    spark, path, at = step.sparkSession, step._saved_at, all_._saved_at
    ship(spark)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            src, w, first, targets, names = _graph(path)
            every = _column(at)
            place = pc.index_in(every, value_set=names).to_numpy(zero_copy_only=False)
            known = ~np.isnan(place.astype(np.float64))
            home = np.zeros((len(names), 1))
            home[place[known].astype(np.int64)] = 1 / n

            def pushed(x: np.ndarray) -> np.ndarray:
                out = np.zeros_like(x)
                if len(first):
                    out[targets] = alpha * np.add.reduceat(x[src, 0] * w, first)[:, None]
                return out

            x = solve(pushed, home, alpha)[:, 0] if len(names) else np.zeros(0)
            rank = np.full(len(every), 1 / n)
            rank[known] = x[place[known].astype(np.int64)]
            whole = x.sum() + (~known).sum() / n
            for i in range(0, len(every), 10_000):
                yield pa.RecordBatch.from_arrays([every[i : i + 10_000], pa.array(rank[i : i + 10_000] / whole)], ["node_id", "rank"])

    out = T.StructType([T.StructField("node_id", all_.schema["node_id"].dataType), T.StructField("rank", T.DoubleType())])
    return spark.range(1).repartition(1).mapInArrow(run, out)


def _uniform_by_parts(step: DataFrame, all_: DataFrame, n: int, alpha: float) -> DataFrame:
    """The same of a graph beyond HELD: what a component's nodes start with stays in it, so each part is solved by itself, larger components by rounds over their steps, and all is scaled together."""
    spark = step.sparkSession
    ship(spark)
    folder, rest_steps, step, own = _parts(step, all_.select(F.col("node_id").alias("source_id"), F.col("node_id").alias("seed")))
    homes = scratch(spark, "pagerank-homes")
    own.filter("part <> ''").select("part", "seed").repartition("part").write.partitionBy("part").parquet(homes)

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                src, w, first, targets, names = _graph(f"{folder}/part={part}")
                home = np.zeros((len(names), 1))
                home[pc.index_in(_column(f"{homes}/part={part}"), value_set=names).to_numpy().astype(np.int64)] = 1 / n

                def pushed(x: np.ndarray) -> np.ndarray:
                    out = np.zeros_like(x)
                    out[targets] = alpha * np.add.reduceat(x[src, 0] * w, first)[:, None]  # noqa: B023
                    return out

                yield pa.RecordBatch.from_arrays([names, pa.array(solve(pushed, home, alpha)[:, 0])], ["node", "r"])

    out = T.StructType([T.StructField("node", step.schema["src"].dataType), T.StructField("r", T.DoubleType())])
    start = own.select(F.col("seed").alias("node"), F.lit(1.0 / n).alias("r"), "part")
    parts = own.filter("part <> ''").select("part").distinct()
    total = parts.repartition(partitions(spark), "part").mapInArrow(run, out).unionByName(start.filter("part = ''").drop("part"))
    if rest_steps is not None:
        rest = grown = start.filter("part IS NULL").drop("part")
        left = 1.0
        while left > RESIDUAL:
            for _ in range(CUT):
                rest = saved(rest.join(rest_steps, rest["node"] == rest_steps["src"]).groupBy("dst").agg(F.sum(alpha * F.col("r") * F.col("w")).alias("r")).withColumnRenamed("dst", "node"), "pagerank-rest")
                grown = grown.unionByName(rest)
            grown = saved(grown.groupBy("node").agg(F.sum("r").alias("r")), "pagerank-total")
            left = rest.agg(F.sum("r")).first()[0] or 0.0
        total = total.unionByName(grown)
    total = saved(total, "pagerank-whole")
    return total.crossJoin(F.broadcast(total.agg(F.sum("r").alias("whole")))).select(F.col("node").alias("node_id"), (F.col("r") / F.col("whole")).alias("rank"))  # one row of totals


def _column(path: str) -> pa.Array:
    """The only column of a table in the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    c = pq.read_table(at, filesystem=system).column(0)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def removal_losses(src: np.ndarray, dst: np.ndarray, n: int, s: int, t: int, asked: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """For each asked node, the share of t's PageRank from s that is lost without it, over edges between numbered nodes.

    Without node i the steps of those before it are shared by their other ends, so P differs by a factor for each of these, and column i of a block of right-hand sides has its own factors: all asked nodes are solved side by side, each
    to the residual of rounding. Nodes that s does not reach, s and t lose nothing.
    """
    counted, size = np.unique(np.stack([dst, src]), axis=1, return_counts=True)
    (to, of), c = counted, size.astype(np.float64)
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    out = np.bincount(of, c, n)
    lost = np.zeros(len(asked))

    def ranks(scale: np.ndarray, without: np.ndarray) -> np.ndarray:
        """Ranks from s, a column for each node left out (-1: none)."""
        gone = np.flatnonzero(without >= 0)

        def pushed(x: np.ndarray) -> np.ndarray:
            y = np.zeros_like(x)
            y[to[first]] = alpha * np.add.reduceat((x * scale)[of] * c[:, None], first, axis=0)
            y[without[gone], gone] = 0
            return y

        home = np.zeros((n, len(without)))
        home[s] = 1
        x = solve(pushed, home, alpha, 1e-15)
        return x / x.sum(axis=0)

    share = np.divide(1.0, out, out=np.zeros(n), where=out > 0)
    whole = ranks(share[:, None], np.array([-1]))[:, 0]
    if whole[t] <= 1e-9:
        return lost
    open_ = np.flatnonzero((whole[asked] > 0) & (asked != s) & (asked != t))
    step = max(1, CELLS // max(1, len(c)))
    for at in range(0, len(open_), step):
        some = asked[open_[at : at + step]]
        scale = np.repeat(share[:, None], len(some), axis=1)
        for k, i in enumerate(some):
            into = slice(*np.searchsorted(to, [i, i + 1]))
            left = out[of[into]] - c[into]
            scale[of[into], k] = np.divide(1.0, left, out=np.zeros(len(left)), where=left > 0)
        lost[open_[at : at + step]] = np.maximum(0.0, whole[t] - ranks(scale, some)[t]) / whole[t]
    lost[lost < NOTHING] = 0
    return lost


def necessity(sub_edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, node, necessity_ab, necessity_ba, necessity) of the nodes of each pair's subgraph (pair_id, src, dst).

    Necessity from a to b is the share of b's PageRank from a that is lost without the node; negative losses, the ends themselves, and pairs without such rank count as 0. A pair's nodes are dealt to as many tasks as its nodes
    times its steps hold CELLS; each of them has the pair's steps and its own nodes and solves CELLS numbers at once.
    """
    ship(sub_edges.sparkSession)
    edges = saved(sub_edges.select("pair_id", "src", "dst").join(pairs.select("pair_id", "a", "b"), "pair_id"), "necessity-edges")  # read for sizes, nodes and steps
    nodes = edges.select("pair_id", "a", "b", F.explode(F.array("src", "dst")).alias("node")).distinct()
    size = edges.groupBy("pair_id").agg(F.count("*").alias("m")).join(nodes.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id").select("pair_id", F.ceil(F.col("m") * F.col("n") / (8.0 * CELLS)).cast("int").alias("blocks"))
    sent = edges.join(size, "pair_id").select("pair_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "a", "b", "src", "dst")
    asked = nodes.join(size, "pair_id").select("pair_id", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "a", "b", F.lit(None).cast("string").alias("src"), F.col("node").alias("dst"))

    def solved(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, own = pdf["a"].iloc[0], pdf["b"].iloc[0], pdf["src"].isna()
        ends = pdf[~own]
        nodes = pd.Index(sorted({*ends["src"], *ends["dst"]}))
        src, dst, wanted = nodes.get_indexer(ends["src"]), nodes.get_indexer(ends["dst"]), nodes.get_indexer(pdf.loc[own, "dst"])
        there = a in nodes and b in nodes
        ab, ba = (removal_losses(src, dst, len(nodes), nodes.get_loc(s), nodes.get_loc(t), wanted) if there else np.zeros(len(wanted)) for s, t in ((a, b), (b, a)))
        return pd.DataFrame({"pair_id": key[0], "node": pdf.loc[own, "dst"].to_numpy(), "necessity_ab": ab, "necessity_ba": ba, "necessity": np.maximum(ab, ba)})

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return sent.unionByName(asked).groupBy("pair_id", "block").applyInPandas(solved, f"pair_id {kind}, node string, necessity_ab double, necessity_ba double, necessity double")
