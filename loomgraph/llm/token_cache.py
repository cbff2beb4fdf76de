"""Token counts with a digest cache.

Method: every text is keyed by the digest of its normalised content and by the digest of the tokenizer (its file and the
version of its library). Keys are joined to the stored counts; of the keys that miss, one document each is encoded, and
their counts are appended to the cache as a new immutable batch of Parquet files. The normal form must not change a
count, so it is the identity on text and turns null into the empty text.

Only digests and ids are grouped, with map-side aggregation, so copies in any number meet as one row for each task; the
texts of the chosen documents are fetched by document id, a key without skew.

Defined results: null counts as empty (0 bytes, 0 tokens); repeated rows, also of one id, each get their count; an empty
table gives an empty result and appends nothing that matters; a cache that does not exist yet is empty.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
LIMIT = 512
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's file and of its library's version."""
    import sentencepiece
    import tokenizers

    version = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(version.encode() + b"\0" + f.read()).hexdigest()


def counter(path: str):
    """A function from texts to token counts, by the library that the file's ending names."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            _loaded[path] = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; the cache at that path gains the counts it lacked."""
    spark = docs.sparkSession
    common.ship(spark)
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.coalesce(F.col(id_col).cast("string"), F.sha2(text.cast("binary"), 256))  # rows without an id are known by their text
    keyed = docs.select(F.col(id_col).alias("_id"), row.alias("_row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    keyed = common.saved(keyed, "token-keys")
    stored = read_cache(spark, cache).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    # One row for each missing key.
    distinct = common.saved(keyed.groupBy("content_digest").agg(F.min("_row").alias("_row"), F.count("*").alias("n")), "token-distinct")
    misses = distinct.select("content_digest", "_row").join(stored, "content_digest", "left_anti")

    def encode(batches):
        count, before = counter(tokenizer), None
        for b in batches:
            keys = b.column(0).to_pylist()
            once = pa.array([k != p for k, p in zip(keys, [before, *keys], strict=False)], pa.bool_())  # rows that repeat an id and its text follow each other
            before = keys[-1] if keys else before
            b = b.filter(once)
            texts = b.column(1).to_pylist()
            n, at = [], 0
            while at < len(texts):  # a bounded share of the encodings at a time
                end, size = at, 0
                while end < len(texts) and size < 1_000_000:
                    size += len(texts[end])
                    end += 1
                n += count(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    wanted = (
        docs.select(row.alias("_row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"), text.alias("_text"))
        .join(misses, ["_row", "content_digest"])
        .select("content_digest", "_text")
    )
    new = wanted.mapInArrow(encode, "content_digest binary, n_tokens long").groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer_digest", F.lit(version)).select("content_digest", "tokenizer_digest", "n_tokens")
    new.write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return common.join_unique(keyed, counts, "content_digest", distinct.select("content_digest", "n")).select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
