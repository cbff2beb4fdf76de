"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, common, compaction, divergence, licenses, mixing, near_dedup, quality, sketches, token_cache, token_codec, topk, warc, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = common.table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    model = quality.fit(docs, quality.graded(labels))
    return quality.scored(docs, model).select("doc_id", "expected_grade", "tail_probability", "keep")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return topk.search(vectors, F.col("vec_id") % 20 == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return warc.round_trip(pages, common.scratch(spark, "warc"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return mixing.mixed(docs)


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals, each appended and compacted, then a last compaction; every row as the last version has it."""
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    table = compaction.ShardedTable(spark, common.scratch(spark, "shards"), docs.schema)
    for part in compaction.arrivals(docs, "doc_id", 4):
        table.append(part)
        table.compact()
    version = table.compact(final=True)
    body = F.coalesce("text", F.lit(""))
    return table.read(version).select("doc_id", "lang", "source", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))


def op6_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text"])
    folder = common.scratch(spark, "token-ids")
    return token_codec.read_tokens(token_codec.write_tokens(docs, folder, BYTE_BPE), folder)


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return bpe_trie.encoding_digests(docs, BYTE_BPE)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return token_cache.count_tokens(docs, BYTE_BPE, common.scratch(spark, "token-cache"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return near_dedup.near_duplicates(docs)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return sketches.fingerprints(docs)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return whitening.whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return licenses.digests(licenses.scan(docs))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", ["text", "lang", "source"])
    return divergence.audit(docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_topk_search": op2_topk_search,
    "op3_warc": op3_warc,
    "op4_source_mixing": op4_source_mixing,
    "op5_compaction": op5_compaction,
    "op6_token_codec": op6_token_codec,
    "op7_bpe_trie": op7_bpe_trie,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_fingerprints": op10_fingerprints,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_license_scan": op12_license_scan,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    # All scores of the queries, ranked.
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, (row_number() OVER r)::INT AS rank, vec_id, score FROM s
        WINDOW r AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER r <= 20
    """,
    # Every row comes back from the compacted shards, once.
    "op5_compaction": """
        SELECT doc_id, lang, source, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
    """,
    # Digests and record types of the pages; every page comes back from its archive.
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN head < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN head < page_id THEN head END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    # The same draws from MD5 digests, sorted and summed over whole sources.
    "op4_source_mixing": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                -ln((('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)
                / greatest(0.01, coalesce(pow(1 - (length(text) - length(translate(text, '0123456789!#$%&*+/<=>@[\\]^_`{|}~', '')))::DOUBLE / greatest(length(text), 1), 2), 0.01)) AS key
            FROM documents
        ), s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM s),
        r AS (SELECT *, 2 * source_size AS fill, 2 * source_size / weight AS ratio, 1.5 * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
        l AS (
            SELECT *, (total - coalesce(sum(fill) OVER b, 0)) / (weights - coalesce(sum(weight) OVER b, 0)) AS level FROM r
            WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (SELECT source, source_size::BIGINT AS source_size, least(fill, coalesce(max(level) FILTER (ratio >= level) OVER () * weight, fill)) AS target FROM l),
        e AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
        k AS (
            SELECT d.*, e.source_size, target, budget - epochs * e.source_size AS rest, epochs,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
        )
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM k
    """,
    # All pairs of a language's sources over all of its terms.
    "op13_source_divergence": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS row FROM d)),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
        s AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2)::BIGINT // (coalesce(t.total, 0) + 2 * l.v)::BIGINT AS p,
                1 + 1000000000 * (k.n + 2)::BIGINT // (l.total + 2 * l.v)::BIGINT AS q
            FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)
        ), pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q
        )
        SELECT *, (row_number() OVER r)::INT AS rank FROM every WINDOW r AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER r <= 10
    """,
}
