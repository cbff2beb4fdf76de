"""Matching of phrase sets: soft and hard precision, recall and F1, and their variants over the best candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved
from . import nearest

#: Share of the soft metrics, and thresholds of a hit.
SOFT = 0.5
THRESHOLD, THRESHOLD_RAW = 0.4, 0.6
SHARES = {"p50": 0.5, "p75": 0.75}


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0))


def soft_hard_prf(pairs: DataFrame, doc: str = "doc", feature: str = "feature", phrase: str = "phrase", similarity: str = "similarity", threshold: float = THRESHOLD, soft: float = SOFT) -> DataFrame:
    """(doc, precision, recall, f1) and their soft and hard parts, from the similarity of every feature with every candidate phrase of a document.

    A side's best matches are averaged (soft) and counted from the threshold on (hard); precision, recall and F1 are blended one by one, so F1 is
    not the mean of the other two.
    """

    def side(by: str, name: str) -> DataFrame:
        best = pairs.groupBy(doc, by).agg(F.max(similarity).alias("best"))
        return best.groupBy(doc).agg(F.avg("best").alias(f"{name}_soft"), F.avg((F.col("best") >= threshold).cast("double")).alias(f"{name}_hard"))

    both = side(phrase, "precision").join(side(feature, "recall"), doc)
    for kind in ("soft", "hard"):
        both = both.withColumn(f"f1_{kind}", f1(F.col(f"precision_{kind}"), F.col(f"recall_{kind}")))
    for m in ("precision", "recall", "f1"):
        both = both.withColumn(m, soft * F.col(f"{m}_soft") + (1 - soft) * F.col(f"{m}_hard"))
    return both


def prf_of_best(of_phrases: DataFrame, of_features: DataFrame, doc: str = "doc", threshold: float = THRESHOLD, soft: float = SOFT) -> DataFrame:
    """soft_hard_prf from each phrase's and each feature's best similarity (doc, similarity) alone, as nearest.best_partners finds them."""

    def side(best: DataFrame, name: str) -> DataFrame:
        return best.groupBy(doc).agg(F.avg("similarity").alias(f"{name}_soft"), F.avg((F.col("similarity") >= threshold).cast("double")).alias(f"{name}_hard"))

    both = side(of_phrases, "precision").join(side(of_features, "recall"), doc)
    for kind in ("soft", "hard"):
        both = both.withColumn(f"f1_{kind}", f1(F.col(f"precision_{kind}"), F.col(f"recall_{kind}")))
    for m in ("precision", "recall", "f1"):
        both = both.withColumn(m, soft * F.col(f"{m}_soft") + (1 - soft) * F.col(f"{m}_hard"))
    return both


def prf_of_vectors(features: DataFrame, phrases: DataFrame, share: float | None = None, doc: str = "doc", threshold: float = THRESHOLD, soft: float = SOFT) -> DataFrame:
    """soft_hard_prf, or topk_prf with a share, of features (doc, item, v) and phrases (doc, item, v), without a row for each pair."""
    renamed = lambda df: df.withColumnRenamed("item", "partner")
    best = saved(nearest.best_partners(phrases, renamed(features), doc), "matching-best")
    if share is not None:
        own = Window.partitionBy(doc)
        ranked = best.withColumn("r", F.row_number().over(own.orderBy(F.desc("similarity"), "item"))).withColumn("n", F.count("*").over(own))
        best = saved(ranked.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(share * F.col("n")))).select(doc, "item", "similarity"), "matching-best")
        phrases = phrases.join(best.select(doc, "item"), [doc, "item"], "left_semi")
    return prf_of_best(best, nearest.best_partners(features, renamed(phrases), doc), doc, threshold, soft)


def topk_prf(pairs: DataFrame, share: float, doc: str = "doc", feature: str = "feature", phrase: str = "phrase", similarity: str = "similarity", threshold: float = THRESHOLD, soft: float = SOFT) -> DataFrame:
    """soft_hard_prf over each document's best candidates only: a share of them, one at least."""
    best = pairs.groupBy(doc, phrase).agg(F.max(similarity).alias("best"))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("best"), phrase))).withColumn("n", F.count("*").over(Window.partitionBy(doc)))
    kept = ranked.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(share * F.col("n")))).select(doc, phrase)
    return soft_hard_prf(pairs.join(kept, [doc, phrase], "left_semi"), doc, feature, phrase, similarity, threshold, soft)


def best_matches(pairs: DataFrame, doc: str = "doc", feature: str = "feature", phrase: str = "phrase", similarity: str = "similarity", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, feature, best_phrase, best_similarity, covered): each feature's best phrase, ties to the first by name."""
    best = pairs.groupBy(doc, feature).agg(F.min(F.struct((-F.col(similarity)).alias("s"), phrase)).alias("b"))
    return best.select(doc, feature, F.col(f"b.{phrase}").alias("best_phrase"), (-F.col("b.s")).alias("best_similarity"), (-F.col("b.s") >= threshold).alias("covered"))


def faithfulness(sims: DataFrame, doc: str = "doc", sentence: str = "sentence", similarity: str = "similarity", grounded: float = 0.35) -> DataFrame:
    """(doc, kg_faithfulness, grounding_ratio, mean, median, low, high): each sentence's best similarity to the evidence, averaged and as an angle."""
    from ..functions.scalars import angular

    best = sims.groupBy(doc, sentence).agg(F.max(similarity).alias("best"))
    return best.groupBy(doc).agg(
        F.avg(angular(F.col("best"))).alias("kg_faithfulness"), F.avg((F.col("best") >= grounded).cast("double")).alias("grounding_ratio"), F.avg("best").alias("mean_similarity"),
        F.percentile("best", 0.5).alias("median_similarity"), F.min("best").alias("min_similarity"), F.max("best").alias("max_similarity"),
    )
