"""A training corpus in four stages: quality classifier, near-duplicate removal, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``. Null texts and texts without words leave in the first stage,
rows without an id are never taken for copies, rows that repeat an id and its text are one after the second stage, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe_trie, common, mixing, near_dedup, quality
from loomgraph.llm.queries import BYTE_BPE


#: Rated documents that the weights of the mix are fitted to, at most: weights need less than the first stage's decisions, and the driver holds both fits' features.
WEIGHT_SAMPLE = 4_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the rated ones among them, puts into the best grade."""
    labels = common.table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    names = common.private(docs.columns, *quality.SCORES)
    return quality.scored(docs, quality.fit(docs, quality.graded(labels)), names=names).filter(F.col(names[2])).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return near_dedup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Their quality weight is the classifier's probability of the best grade; the classifier is fitted to at most WEIGHT_SAMPLE rated ones of all documents, since those
    that the first stage kept have one grade."""
    labels = common.table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    model = quality.fit(common.table(spark, sf_dir, "documents", ["doc_id", "text"]), quality.graded(labels), sample=WEIGHT_SAMPLE)
    names = common.private(docs.columns, *quality.SCORES)
    scored = common.saved(quality.scored(docs, model, names=names), "pipeline-scored")  # scores are read twice below
    return mixing.mix(scored, quality_col=F.coalesce(F.col(f"_row.{names[1]}"), F.lit(1.0))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, with digests of the ids and of the text decoded from them."""
    return bpe_trie.encoding_digests(docs, BYTE_BPE, with_ids=True)


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", without_near_duplicates),
    ("source_mixing", mixed_sources),
    ("bpe_encoding", encoded),
]

#: Model, signatures and merges are beyond SQL; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
