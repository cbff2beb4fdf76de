"""Selection operators: maximal marginal relevance and lexicon matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import discard, saved

#: Fixed value: weight of relevance against likeness to what has been chosen.
RELEVANCE = 0.7
#: Items of a group that are chosen from in one call, and items that a lazy round looks at again.
GROUP, FRESH = 100_000, 32
#: Distinct tokens of a lexicon's features, and characters of both, up to which each task holds the lexicon.
HELD_TOKENS, HELD_CHARS = 100_000, 16 << 20


def mmr(items: DataFrame, queries: DataFrame, k: int, weight: float = RELEVANCE) -> DataFrame:
    """(grp, item, rank): for each group k items that are like its query and unlike one another; ties to the smaller item.

    items: grp, item, embedding; items are distinct within a group. queries: grp, query. Greedy choice of k items is sequential within a group; groups are independent. A group of up to GROUP items is chosen from in one call, larger ones lazily
    over all partitions.
    """
    known = items.filter("embedding IS NOT NULL").select("grp", "item", "embedding")
    large = known.groupBy("grp").agg(F.count("*").alias("_n")).filter(F.col("_n") > GROUP).select("grp")
    if not large.limit(1).count():
        return _chosen_at_once(known, queries, k, weight)
    large = saved(large, "mmr-large")
    return _chosen_at_once(known.join(large, "grp", "left_anti"), queries, k, weight).unionByName(_chosen_lazily(known.join(large, "grp", "left_semi"), queries, k, weight))


def _chosen_at_once(items: DataFrame, queries: DataFrame, k: int, weight: float) -> DataFrame:
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        v, q = np.stack(pdf["embedding"].to_numpy()).astype(float), np.asarray(pdf["query"].iloc[0], dtype=float)
        relevance = np.round(v @ q, 9)
        likeness = np.full(len(v), -np.inf)
        taken: list[int] = []
        for _ in range(min(k, len(v))):
            score = relevance if not taken else weight * relevance - (1 - weight) * likeness
            score = score.copy()
            score[taken] = -np.inf
            best = int(np.argmax(score))
            taken.append(best)
            likeness = np.maximum(likeness, np.round(v @ v[best], 9))
        return pd.DataFrame({"grp": pdf["grp"].iloc[taken].to_numpy(), "item": pdf["item"].iloc[taken].to_numpy(), "rank": np.arange(1, len(taken) + 1, dtype=np.int32)})

    kinds = {c: items.schema[c].dataType.simpleString() for c in ("grp", "item")}
    return items.join(queries, "grp").groupBy("grp").applyInPandas(choose, f"grp {kinds['grp']}, item {kinds['item']}, rank int")


def _chosen_lazily(items: DataFrame, queries: DataFrame, k: int, weight: float) -> DataFrame:
    """Greedy choice by stale bounds. An item's likeness to the chosen ones only grows, so the score it had when last looked at bounds what it has now. A round looks again at the FRESH items of a group with the highest bounds, and if the best of them
    beats the next bound it is the winner; else more are looked at. All vectors are read for the first two choices, and those of a few items for each of the others; a group is spread over all partitions."""
    dot = lambda x, y: F.round(F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, z: s + z), 9)
    score = weight * F.col("relevance") - (1 - weight) * F.col("likeness")
    rows = items.join(queries, "grp").select("grp", "item", dot(F.col("embedding"), F.col("query")).alias("relevance"), "embedding")
    first = rows.groupBy("grp").agg(F.min_by(F.struct("item", "embedding"), F.struct(-F.col("relevance"), "item")).alias("b")).select("grp", "b.item", "b.embedding", F.lit(1).alias("rank"))
    chosen = saved(first, "mmr-chosen")
    like_first = chosen.select("grp", F.col("embedding").alias("_c"))
    state = saved(rows.join(like_first, "grp").select("grp", "item", "relevance", dot(F.col("embedding"), F.col("_c")).alias("likeness")).join(chosen, ["grp", "item"], "left_anti"), "mmr-state")
    for rank in range(2, k + 1):
        fresh = FRESH
        while True:
            place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("bound"), "item"))
            top = saved(state.withColumn("bound", score).withColumn("place", place).filter(F.col("place") <= fresh + 1), "mmr-top")
            again = top.filter(F.col("place") <= fresh).join(items, ["grp", "item"]).join(chosen.select("grp", F.col("embedding").alias("_c")), "grp").groupBy("grp", "item").agg(F.max(dot(F.col("embedding"), F.col("_c"))).alias("_now"))
            again = saved(again, "mmr-again")
            before, state = state, saved(state.join(again, ["grp", "item"], "left").select("grp", "item", "relevance", F.coalesce("_now", "likeness").alias("likeness")), "mmr-state")
            told = top.drop("likeness").join(again.withColumnRenamed("_now", "likeness"), ["grp", "item"], "left")
            best = told.groupBy("grp").agg(F.min_by("item", F.when(F.col("place") <= fresh, F.struct(-score, "item"))).alias("item"), F.max(F.when(F.col("place") <= fresh, score)).alias("score"), F.max(F.when(F.col("place") > fresh, F.col("bound"))).alias("next"))
            best = saved(best, "mmr-best")
            discard(before)
            if not best.filter("next >= score").limit(1).count():
                break
            fresh *= 4
        new = saved(best.select("grp", "item").join(items, ["grp", "item"]).select("grp", "item", "embedding", F.lit(rank).alias("rank")), "mmr-chosen")
        chosen, state = chosen.unionByName(new), state.join(new, ["grp", "item"], "left_anti")
    return chosen.select("grp", "item", "rank")


def lexicon_matches(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, feature): the features of a lexicon (feature) that each text has; rows without an id count as one text each and come without one.

    A feature's tokens stand as whole words in a text that has it, so its rarest token, by the number of texts, is joined to the texts' distinct words; what meets there is then looked at in
    full. Words travel with their text's id and digest, and each text is fetched once for the features it may have: a text of n words is never copied n times. The lexicon goes to the
    tasks whole up to HELD_TOKENS and HELD_CHARS and is shuffled beyond; words and texts are never broadcast.
    """
    rows = docs.select(F.col(id_col).alias("_id"), T.normalize(F.col(text_col)).alias("_t")).withColumn("_d", F.sha2("_t", 256))
    # The pattern's words are runs of letters, digits and underscores of any script; tokens are lower-cased and texts are not.
    words = rows.select("_id", "_d", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(r"(?U)\w+"), 0))).alias("_w"))
    features = lexicon.select("feature").distinct().select("feature", T.tokens(T.normalize(F.col("feature"))).alias("_tokens")).filter(F.size("_tokens") > 0)
    wanted = saved(features.select("feature", "_tokens", F.explode(F.array_distinct("_tokens")).alias("_w")), "lexicon")
    n, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("feature") + F.length("_w")), F.lit(0))).first()
    how = "broadcast" if n <= HELD_TOKENS and chars <= HELD_CHARS else "merge"
    often = words.join(wanted.select("_w").distinct().hint(how), "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_n"))
    key = wanted.join(often, "_w", "left").groupBy("feature").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_w")).alias("_k"), F.first("_tokens").alias("_tokens")).filter("_k.n > 0")
    met = words.join(key.select("feature", "_tokens", F.col("_k._w").alias("_w")).hint(how), "_w").select(F.col("_id").alias("_of"), F.col("_d").alias("_is"), "feature", "_tokens").distinct()
    full = rows.hint("merge").join(met, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_d") == F.col("_is")))
    return full.filter(T.contains_tokens(F.col("_t"), F.col("_tokens"))).select(F.col("_id").alias(id_col), "feature")
