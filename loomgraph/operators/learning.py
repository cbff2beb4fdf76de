"""Data for graph learning: leakage-safe splits, node features, relation vocabulary, negative samples, calibration and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..runtime import discard, saved
from . import graph
from .ordering import running_sums

#: Separator of compound relations; share of hard negatives, of validation pairs; negatives for each training and validation pair; calibration and blend.
SEPARATOR = "|||"
HARD, VALIDATION, TRAIN_NEGATIVES, VALIDATION_NEGATIVES, LEAST_VALIDATION = 0.7, 0.15, 3, 2, 10
LOW, HIGH, ALPHA, BLEND = 0.01, 1.0, 2.0, 0.7


def split_labels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(message edges, label edges): edges whose type names a synthetic-lethal relation pass no messages; curated ones are labels."""
    sl = scalars.is_sl_like(F.col("type"))
    return edges.filter(~sl), edges.filter(sl & (F.col("source") == "curated"))


def assert_no_leak(edges: DataFrame) -> None:
    """Refuse message edges that hold label relations."""
    if edges.filter(scalars.is_sl_like(F.col("type"))).limit(1).count():
        raise ValueError("label relations among the message edges")


def relation_vocab(edges: DataFrame) -> DataFrame:
    """(relation, index) of the distinct pairs of type and source, by name from 0."""
    r = edges.select(F.concat_ws(SEPARATOR, F.coalesce("type", F.lit("unknown")), F.coalesce("source", F.lit("unknown"))).alias("relation")).distinct()
    return r.select("relation", (F.row_number().over(Window.orderBy("relation")) - 1).alias("index"))  # a row for each relation


def edge_index(edges: DataFrame, nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """(src_index, dst_index, relation_index) of edges between known nodes (node_id, index)."""
    r = edges.withColumn("relation", F.concat_ws(SEPARATOR, F.coalesce("type", F.lit("unknown")), F.coalesce("source", F.lit("unknown"))))
    i = r.join(nodes.select(F.col("node_id").alias("src"), F.col("index").alias("src_index")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("index").alias("dst_index")), "dst")
    return i.join(vocab.withColumnRenamed("index", "relation_index"), "relation").select("src_index", "dst_index", "relation_index")


def relation_counts(edges: DataFrame) -> DataFrame:
    """(node, type, n, scaled): edges of each type at a node, a loop twice, and their logarithm over the type's largest."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.coalesce("type", F.lit("unknown")).alias("type"))
    n = ends.groupBy("node", "type").agg(F.count("*").alias("n"))
    most = n.groupBy("type").agg(F.max("n").alias("most"))
    return n.join(most, "type").select("node", "type", "n", (F.log1p("n") / F.log1p("most")).alias("scaled"))


def scaled_log_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, log_degree): log(1 + degree) scaled to [0, 1] over all nodes."""
    d = nodes.select("node_id").join(graph.undirected_degree(edges).withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.log1p(F.coalesce("degree", F.lit(0))).alias("x"))
    d = saved(d, "log-degrees")  # read for its bounds and for its rows
    span = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return d.crossJoin(F.broadcast(span)).select("node_id", scalars.min_max(F.col("x"), F.col("lo"), F.col("hi")).alias("log_degree"))  # one row of bounds


def uniform_pagerank(edges: DataFrame, nodes: DataFrame, rounds: int, alpha: float = 0.85) -> DataFrame:
    """(node_id, rank): PageRank with uniform teleport, after a fixed number of rounds; rank of nodes without outgoing edges is shared by all."""
    from .pagerank import CUT, transitions

    step, all_ = transitions(edges), nodes.select("node_id").distinct()
    n = all_.count()
    rank = all_.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(1, rounds + 1):
        moved = rank.join(step, rank["node_id"] == step["src"], "left")
        # Null collects what dangles; it is one row, and goes back to all.
        sums = moved.groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") * F.coalesce("w", F.lit(1.0))).alias("got"))
        sums = saved(sums, "pagerank") if i % CUT == 0 else sums
        spare = sums.filter("node_id IS NULL").agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("spare"))
        rank = all_.join(sums.filter("node_id IS NOT NULL"), "node_id", "left").crossJoin(F.broadcast(spare)).select("node_id", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("spare") / n) + (1 - alpha) / n).alias("rank"))
    return rank


def node_features(nodes: DataFrame, edges: DataFrame, kinds: list[str], types: list[str], pagerank: DataFrame) -> DataFrame:
    """(node_id, features): one-hot type, scaled log degree, scaled counts of each edge type, scaled PageRank."""
    counts = relation_counts(edges).groupBy("node").pivot("type", types).agg(F.first("scaled")).withColumnRenamed("node", "node_id")
    span = pagerank.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    pr = pagerank.crossJoin(F.broadcast(span)).select("node_id", scalars.min_max(F.col("rank"), F.col("lo"), F.col("hi")).alias("pr"))  # one row of bounds
    whole = nodes.select("node_id", "type").join(scaled_log_degree(edges, nodes), "node_id").join(counts, "node_id", "left").join(pr, "node_id", "left")
    hot = [F.when(F.col("type") == k, 1.0).otherwise(0.0) for k in kinds]
    return whole.select("node_id", F.array(*hot, F.col("log_degree"), *(F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in types), F.coalesce("pr", F.lit(0.0))).alias("features"))


def unordered(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct unordered pairs (a, b) with a < b."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def hard_negatives(edges: DataFrame, nodes: DataFrame, positives: DataFrame, kind: str = "gene") -> DataFrame:
    """Pairs of nodes of the kind with an edge between them that are not positive."""
    k = nodes.filter(F.contains(F.col("type"), F.lit(kind))).select("node_id")
    inner = edges.join(k.withColumnRenamed("node_id", "src"), "src", "left_semi").join(k.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return unordered(inner, "src", "dst").join(unordered(positives), ["a", "b"], "left_anti")


def distant_negatives(edges: DataFrame, nodes: DataFrame, positives: DataFrame, kind: str = "gene") -> DataFrame:
    """Pairs of nodes that occur in positives, neither positive nor joined by an edge. All pairs of labelled nodes, by definition: their number, hundreds to thousands, bounds it."""
    p = unordered(positives)
    known = p.select(F.col("a").alias("n")).unionByName(p.select(F.col("b").alias("n"))).distinct()
    every = known.select(F.col("n").alias("a")).join(known.select(F.col("n").alias("b")), F.col("a") < F.col("b"))
    return every.join(p, ["a", "b"], "left_anti").join(hard_negatives(edges, nodes, positives, kind), ["a", "b"], "left_anti")


def hash_order(*columns: str, seed: str = "42") -> Column:
    """A reproducible random order that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def sample(hard: DataFrame, distant: DataFrame, n: int, hard_share: float = HARD, seed: str = "42") -> DataFrame:
    """n negatives, hard and distant in their shares, fewer where a pool is too small."""
    h = int(n * hard_share)
    few = lambda df, m, kind: df.orderBy(hash_order("a", "b", seed=seed), "a", "b").limit(m).withColumn("kind", F.lit(kind))
    return few(hard, h, "hard").unionByName(few(distant, n - h, "distant"))


def unranked(rank: Column) -> tuple[Column, Column]:
    """(smaller, larger) of the pair of places with this rank, where pairs (i, j), i < j, are numbered from 0 by j and then i. The root is a double's, so it is set right by a step either way."""
    root = F.floor((1 + F.sqrt(1 + 8 * rank.cast("double"))) / 2)
    below = lambda j: j * (j - 1)  # twice the pairs before j
    large = F.when(below(root) > 2 * rank, root - 1).when(below(root + 1) <= 2 * rank, root + 1).otherwise(root)
    return rank - F.shiftright(below(large), 1), large


def drawn_rank(draw: Column, pairs: int, seed: str = "42") -> Column:
    """The pair that a draw hits: the first 60 bits of a digest of its number, so that other engines can repeat it. Off uniform by less than pairs / 2^60."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), draw)), 1, 15), 16, 10).cast("long") % F.lit(pairs)


def distant_sample(edges: DataFrame, nodes: DataFrame, positives: DataFrame, n: int, kind: str = "gene", seed: str = "42") -> DataFrame:
    """(a, b) of n distinct distant negatives, each set of them as likely as any other; all where there are no more than n.

    Pairs of labelled nodes are numbered, not formed: draws are unranked to pairs, and those that repeat, are positive or are joined by an edge are rejected by joins, until n are left. Work grows with n and with the number of rejected
    pairs and not with the square of the labelled nodes. What comes out does not depend on the number of draws of a round: the pairs with the earliest draws are kept.
    """
    p = unordered(positives)
    known = p.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    known = saved(running_sums(known, [F.col("n")], _i=F.lit(1)).select("n", (F.col("_i") - 1).alias("i")), "negatives-known")
    count = known.count()
    pairs = count * (count - 1) // 2
    linked = hard_negatives(edges, nodes, positives, kind).join(known.select(F.col("n").alias("a")), "a", "left_semi").join(known.select(F.col("n").alias("b")), "b", "left_semi")
    taken = saved(p.unionByName(linked).distinct(), "negatives-taken")
    free = pairs - taken.count()
    want, spark, found, begin = min(n, free), p.sparkSession, None, 0
    if want <= 0:
        return p.limit(0)
    size = 64 + 2 * want * -(-pairs // free)
    while found is None or found.count() < want:
        draws = spark.range(begin, begin + size).select(F.col("id").alias("draw"), drawn_rank(F.col("id"), pairs, seed).alias("r"))
        i, j = unranked(F.col("r"))
        new = draws.groupBy("r").agg(F.min("draw").alias("draw")).select("draw", i.alias("i"), j.alias("j"))
        named = new.join(known.select("i", F.col("n").alias("a")), "i").join(known.select(F.col("i").alias("j"), F.col("n").alias("b")), "j").select("a", "b", "draw")
        named = named.join(taken, ["a", "b"], "left_anti")
        before, found = found, saved((named if found is None else found.unionByName(named)).groupBy("a", "b").agg(F.min("draw").alias("draw")), "negatives-found")
        if before is not None:
            discard(before)
        begin, size = begin + size, 2 * size
    return found.orderBy("draw").limit(want).select("a", "b")


def negatives(edges: DataFrame, nodes: DataFrame, positives: DataFrame, n: int, hard_share: float = HARD, kind: str = "gene", seed: str = "42") -> DataFrame:
    """(a, b, kind) of n negatives, hard and distant in their shares, fewer where a pool is too small."""
    h = int(n * hard_share)
    hard = hard_negatives(edges, nodes, positives, kind).orderBy(hash_order("a", "b", seed=seed), "a", "b").limit(h)
    return hard.withColumn("kind", F.lit("hard")).unionByName(distant_sample(edges, nodes, positives, n - h, kind, seed).withColumn("kind", F.lit("distant")))


def train_validation(positives: DataFrame, share: float = VALIDATION, seed: str = "42") -> DataFrame:
    """positives (a, b) with the column part: validation for the first share in hash order, LEAST_VALIDATION at least."""
    n = positives.count()
    placed = running_sums(positives, [hash_order("a", "b", seed=seed), F.col("a"), F.col("b")], _place=F.lit(1))
    return placed.withColumn("part", F.when(F.col("_place") <= max(LEAST_VALIDATION, int(share * n)), "validation").otherwise("train")).drop("_place")


def calibrated(raw: DataFrame, value: str = "value", method: str = "zscore", low: float = LOW, high: float = HIGH, alpha: float = ALPHA) -> DataFrame:
    """raw with the column weight: values spread over [low, high]. none keeps them; zscore, sphere and sigmoid pass them centred through a
    logistic function; minmax stretches them, to high if all are equal."""
    if method == "none":
        return raw.withColumn("weight", F.col(value).cast("double"))
    all_ = Window.partitionBy()  # weights of edge types or sources: tens of rows
    x = F.col(value).cast("double")
    centred = x - F.avg(x).over(all_)
    if method == "minmax":
        lo, hi = F.min(x).over(all_), F.max(x).over(all_)
        w = F.when(hi - lo < 1e-12, F.lit(high)).otherwise(low + (x - lo) / F.nullif(hi - lo, F.lit(0.0)) * (high - low))
    elif method in ("zscore", "sphere", "sigmoid"):
        norm = F.sqrt(F.var_pop(x).over(all_)) + 1e-12
        if method == "sphere":
            n = F.count("*").over(all_)
            norm = (F.sqrt(F.var_pop(x).over(all_) * n) + 1e-12) / F.sqrt(n)
        spread = centred if method == "sigmoid" else centred / norm
        w = low + (high - low) / (1 + F.exp(-alpha * spread))
    else:
        raise ValueError(f"unknown calibration {method!r}")
    return raw.withColumn("weight", F.round(w, 4))


def blended_weights(attention: DataFrame, drop: DataFrame, share: float = BLEND, fixed: dict[str, float] | None = None) -> DataFrame:
    """(name, weight, priority): calibrated attention and positive counterfactual drops (name, value) blended; priorities from 0 by weight, and names of fixed weight come last."""
    a = calibrated(attention).select("name", F.col("weight").alias("x"))
    d = calibrated(attention.select("name").join(drop, "name", "left").select("name", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("value"))).select("name", F.col("weight").alias("y"))
    w = a.join(d, "name", "full").select("name", F.round(share * F.coalesce("x", F.lit(0.0)) + (1 - share) * F.coalesce("y", F.lit(0.0)), 4).alias("weight"))
    out = w.withColumn("priority", F.row_number().over(Window.orderBy(F.desc("weight"), "name")) - 1)  # tens of rows
    if fixed:
        spark = w.sparkSession
        out = out.filter(~F.col("name").isin(*fixed)).unionByName(spark.createDataFrame([(k, v) for k, v in fixed.items()], "name string, weight double").crossJoin(out.agg((F.max("priority") + 1).alias("priority"))))
    return out


def averages_by_half(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, value) and (source, value): mean scores of compound relations (relation, value) by either half."""
    s = scores.withColumn("p", F.split("relation", r"\|\|\|"))
    return s.groupBy(F.col("p")[0].alias("type")).agg(F.avg("value").alias("value")), s.groupBy(F.col("p")[1].alias("source")).agg(F.avg("value").alias("value"))


def auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(auc, average_precision) of scores for labels 0 and 1, ties shared.

    Distinct scores are aggregated first, so cumulative sums run over a row for each score and not for each example; ranges of scores are summed side by side.
    """
    g = rows.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    c = running_sums(g, [F.desc(score)], tp=F.col("p"), fp=F.col("n"))
    s = c.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return s.select((F.col("area") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("auc"), (F.col("ap") / F.nullif(F.col("P"), F.lit(0))).alias("average_precision"))


def counterfactual_drops(base: DataFrame, masked: DataFrame, item: str = "item") -> DataFrame:
    """(name, value): the mean drop of the items' scores when a type or source is masked. base: item, score. masked: name, item, score."""
    b = base.select(item, F.col("score").alias("_b"))
    return masked.join(b, item).groupBy("name").agg(F.avg(F.col("_b") - F.col("score")).alias("value"))


def type_ranks(norms: DataFrame) -> DataFrame:
    """(type, rank): node types from 1 by their mean norm (type, norm), the largest first."""
    m = norms.groupBy("type").agg(F.avg("norm").alias("m"))
    return m.select("type", F.row_number().over(Window.orderBy(F.desc("m"), "type")).alias("rank"))  # a row for each type
