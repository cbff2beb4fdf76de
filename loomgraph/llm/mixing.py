"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Method: every source gets a target number of words from its weight; no target exceeds ``most`` times its source's size, and
what a source cannot take is shared among the others by weight (water filling, in closed form over the sources in order of
the level at which they fill up). A source is taken in complete epochs as often as its target allows. The fraction
that is left is a weighted sample without replacement: a document's key is an exponential draw divided by its quality weight,
keys are sorted within the source and sizes are prefix-summed up to the budget. The document at the budget's edge is
taken in part, so a source's taken words are its rounded target.

Scale and skew: the keys of a source are cut into SPLIT buckets, and bucket sums (map-side aggregation) tell in which one the budget ends. While that bucket holds more than
BUCKET rows, its own rows are cut in the same way, between its least and its greatest key, whatever the quality weights make of their distribution. What is left is grouped by key, id and size,
so that rows which nothing tells apart are one, and sorted; what comes out is a row for each source, the last
document taken. The mix is then one pass that compares keys. The tables of sources and of buckets are the only ones that windows run over whole.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a source without words has target
0; with no words at all every target is 0. A document without words takes 0. A quality weight that is null, not finite or not positive counts as the least
weight. Draws depend on the id and the seed only, so reruns agree; rows that repeat an id are ordered by their sizes. Columns besides those named are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SEED = "mix-1"
#: Buckets of a cut, and rows of the bucket at a budget's edge that are sorted, at most, unless their keys agree.
SPLIT, BUCKET = 1_024, 4_000
#: Cuts of a bucket: each makes the range of its keys SPLIT times smaller, so doubles run out of digits before.
CUTS = 12
LEAST_QUALITY = 0.01


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A document's quality weight: the share of its characters that are not symbols or digits, squared."""
    n = F.greatest(F.length(text), F.lit(1))
    odd = F.length(text) - F.length(F.translate(text, "0123456789!#$%&*+/<=>@[\\]^_`{|}~", ""))
    return F.pow(1 - odd / n, 2.0)


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A uniform draw in (0, 1) from an id: 52 bits of an MD5 digest, halfway into their interval."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with the column target: a row for each source.

    Sources in order of code points, null last, have the weights in turn. All but the sources that fill up lie at one level of
    words for each unit of weight.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")).cast("double")
    w = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most))
    w = w.withColumn("ratio", F.col("full") / F.col("weight"))
    below = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy()
    # Level if exactly the sources before this one are full; of the levels that their own source stays below, the first and largest holds.
    w = w.withColumn("total", F.sum("source_size").over(over) * float(share)).withColumn("unfilled", F.sum("weight").over(over) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(below), F.lit(0.0))) / F.col("unfilled"))
    w = w.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(over))
    return w.select(*sizes.columns, F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def plan(docs: DataFrame, quality_col: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the kept columns of every row of docs (doc_id, source, text)."""
    good = quality(F.col("text")) if quality_col is None else quality_col
    good = F.when((good > LEAST_QUALITY) & (good < float("inf")), good).otherwise(F.lit(LEAST_QUALITY))
    rows = docs.select("doc_id", F.col("source").alias("_source"), words(F.col("text")).alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / good).alias("_key"), *keep)
    slim = common.saved(rows.select("doc_id", "_source", "size", "_key"), "mix-rows")
    rows = rows if keep else slim
    sizes = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most).withColumnRenamed("source", "_s")
    whole = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    sources = common.saved(sources.withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size")), "mix-sources")

    # The rows around each budget's edge. In the first cut buckets are even in 1 - e^-key, which keys without quality weights fill evenly.
    close = slim.join(sources.select("_s", "rest"), F.col("_source").eqNullSafe(F.col("_s"))).select("_s", "_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size", "rest", F.lit(0).cast("long").alias("done"))
    bucket = F.floor((1 - F.exp(-F.col("_key"))) * SPLIT)
    before = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(CUTS):
        rows_cut = close.withColumn("bucket", F.least(bucket, F.lit(SPLIT - 1)).cast("int")).drop("lo", "hi")
        sums = rows_cut.groupBy("_s", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.first("rest").alias("rest"), F.first("done").alias("done"))
        ends = sums.withColumn("done", F.col("done") + F.coalesce(F.sum("words").over(before), F.lit(0))).filter("done < rest AND done + words >= rest")
        ends = common.saved(ends.select(F.col("_s").alias("_e"), F.col("bucket").alias("edge"), F.col("done").alias("_done"), "n", "lo", "hi"), "mix-ends")  # a row for each source
        inside = rows_cut.join(ends, F.col("_s").eqNullSafe(F.col("_e")) & (F.col("bucket") == F.col("edge")))
        close = common.saved(inside.select("_s", "_key", "id", "size", "rest", F.col("_done").alias("done"), "lo", "hi"), "mix-close")
        if not ends.filter((F.col("n") > BUCKET) & (F.col("lo") < F.col("hi"))).head(1):
            break
        bucket = F.when(F.col("lo") < F.col("hi"), F.floor((F.col("_key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SPLIT)).otherwise(F.lit(0))
    # The row at each edge, found among the distinct keys, ids and sizes of its bucket; rows that nothing tells apart share alike.
    at = F.struct("_key", "id", "size")
    alike = close.groupBy("_s", at.alias("_at")).agg(F.sum("size").alias("words"), F.count("*").alias("alike"), F.first("rest").alias("rest"), F.first("done").alias("done"))
    within = Window.partitionBy("_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("done") + F.coalesce(F.sum("words").over(within), F.lit(0))
    last = alike.withColumn("start", start).filter("start < rest AND start + words >= rest")
    edges = common.saved(last.select(F.col("_s").alias("_e"), F.col("_at").alias("last"), F.expr("(rest - start) div alike").alias("cut")), "mix-edges")
    known = rows.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).join(edges, F.col("_s").eqNullSafe(F.col("_e")), "left")
    known = known.withColumn("_at", F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size"))
    part = F.when(F.col("last").isNull() | (F.col("_at") > F.col("last")), F.lit(0)).when(F.col("_at") == F.col("last"), F.least("size", "cut")).otherwise(F.col("size"))
    return known.select("doc_id", "size", "source_size", "target", "epochs", *keep, part.alias("part")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size long, source_size long, target double, taken long) of every row."""
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. The document at a budget's edge is taken whole if at least half of it falls within.

    Documents without words are in no mix.
    """
    inner = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    times = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = plan(inner, keep=("_row",), **options).filter("size > 0").withColumn("_times", times.cast("int")).filter("_times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")
