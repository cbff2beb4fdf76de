"""Queries of the text operators over documents, conversations, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import matching, nearest, selection
from . import harness as h
from .registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in [*text.STOPWORDS, *text.JUNK_TOKENS]) + "]"


def _re(pattern: str) -> str:
    """A pattern for DuckDB: without Java's Unicode flag."""
    return pattern.replace("(?Uis)", "(?is)").replace("(?Ui)", "(?i)").replace("(?U)", "").replace("(?Us)", "(?s)").replace("'", "''")


#: DuckDB's word boundary knows ASCII only; these are a boundary before and after a word of any script.
_OPEN, _SHUT = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"


def _strip_sql(c: str) -> str:
    out = f"regexp_replace({c}, '{_re(text.REFERENCES)}', '')"
    for p in (text.URL, text.BRACKETS, text.PMID, text.DOI, text.EDGE_CITATION, text.NODE_ID, text.REACTOME_ID):
        if "\\b" in p and p != text.EDGE_CITATION:
            out = f"regexp_replace({out}, '{_re(p).replace(chr(92) + 'b', _OPEN, 1)}', '\\1 ', 'g')"
        else:
            out = f"regexp_replace({out}, '{_re(p)}', ' ', 'g')"
    return out


def _trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({_strip_sql(_trim_sql('text'))}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_trim_sql('x')}), lambda x: length(x) >= 25)"


@query(f"SELECT doc_id, length(s)::INT AS n, md5(s) AS digest FROM (SELECT doc_id, {_strip_sql('text')} AS s FROM documents)")
def strip_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.strip_citations(F.col("text"))
    return h.read(spark, sf_dir, "documents").select("doc_id", F.length(s).alias("n"), F.md5(s).alias("digest"))


@query(f"SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return h.read(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(f"""
    WITH d AS (SELECT doc_id, {_trim_sql('text')} AS t FROM documents),
    c AS (SELECT doc_id, CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 1200 THEN [t] ELSE list_filter(list_transform(range(0, length(t), 900), lambda i: {_trim_sql('substr(t, i + 1, 1200)')}), lambda x: x <> '') END AS c FROM d)
    SELECT doc_id, len(c)::INT AS n, list_transform(c, lambda x: length(x)::INT) AS lengths, md5(array_to_string(c, '|')) AS digest FROM c
""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = h.read(spark, sf_dir, "documents").select("doc_id", text.chunks(F.col("text")).alias("c"))  # a column of its own, so that it is worked out once
    return cut.select("doc_id", F.size("c").alias("n"), F.transform("c", F.length).alias("lengths"), F.md5(F.array_join("c", "|")).alias("digest"))


@query(f"""
    WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda x: {_trim_sql('x')}), lambda x: x <> '') AS p FROM documents),
    q AS (SELECT doc_id, list_slice(CASE WHEN len(p) <= 1 THEN list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: {_trim_sql('x')}), lambda x: x <> '') ELSE p END, 1, 24) AS p FROM p)
    SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS digest FROM q
""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text.paragraphs(F.col("text"))
    return h.read(spark, sf_dir, "documents").select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


_ORDER_TEXT = """
    told AS (
        SELECT l_orderkey, string_agg('Line ' || l_linenumber || ' (supplier:' || l_suppkey || ' -> part:' || l_partkey || ' | ' || l_shipmode_like || ' | x | key=' || l_linenumber || ').', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS t
        FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'supplies_to' ELSE 'returned_by' END AS l_shipmode_like FROM lineitem) GROUP BY 1
    )
"""


def _order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = h.read(spark, sf_dir, "lineitem")
    said = F.concat(F.lit("Line "), "l_linenumber", F.lit(" (supplier:"), "l_suppkey", F.lit(" -> part:"), "l_partkey", F.lit(" | "), F.when(F.col("l_returnflag") == "A", "supplies_to").otherwise("returned_by"), F.lit(" | x | key="), "l_linenumber", F.lit(")."))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", said.alias("said"))))
    return li.groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda x: x["said"]), " ").alias("t"))


@query(f"""
    WITH {_ORDER_TEXT}, c AS (SELECT l_orderkey, regexp_extract_all(t, '{_re(text.EDGE_CITATION)}') AS c FROM told)
    SELECT l_orderkey, len(c)::INT AS n, len(list_distinct(list_transform(c, lambda x: regexp_extract(x, '{_re(text.EDGE_KEY)}', 1))))::INT AS keys FROM c
""")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_text(spark, sf_dir).select("l_orderkey", text.citation_count(F.col("t")).alias("n"), text.citation_keys(F.col("t")).alias("keys"))


@query(f"""
    WITH {_ORDER_TEXT.replace("told AS", "colons AS")}, told AS (SELECT l_orderkey, replace(t, ':', ' ') AS t FROM colons), e AS (SELECT l_orderkey, regexp_extract_all(t, '{_re(text.KG_EDGE)}', 1) AS s, regexp_extract_all(t, '{_re(text.KG_EDGE)}', 2) AS d, regexp_extract_all(t, '{_re(text.KG_EDGE)}', 3) AS r FROM told),
    x AS (SELECT l_orderkey, i, trim(s[i]) || ' ' || trim(replace(trim(r[i]), '_', ' ')) || ' ' || trim(d[i]) AS v FROM e, unnest(range(1, len(s) + 1)) AS u(i)),
    f AS (SELECT l_orderkey, lower(v) AS k, arg_min(v, i) AS v, min(i) AS i FROM x WHERE length(v) >= 8 GROUP BY 1, 2)
    SELECT l_orderkey, list(v ORDER BY i) AS lines FROM f GROUP BY 1
""")
def kg_edge_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.kg_sentences(F.translate("t", ":", " "))
    # Exploded, since a filter on the lines would work them out a second time.
    return _order_text(spark, sf_dir).select("l_orderkey", F.explode(F.filter(F.array(lines), lambda x: F.size(x) > 0)).alias("lines"))


_TOKENS = "list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: lower(x))"


def _content_sql(c: str) -> str:
    return f"list_filter({_TOKENS.format(c=c)}, lambda x: NOT list_contains({_STOP}, x) AND NOT regexp_full_match(x, '[0-9]+'))"


@query(f"SELECT doc_id, len({_TOKENS.format(c='text')})::INT AS n_tokens, len({_content_sql('text')})::INT AS n_content, len(list_distinct({_content_sql('text')}))::INT AS n_distinct FROM documents")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = h.read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))  # columns of their own, so that they are worked out once
    own = told.select("doc_id", "t", text.content(F.col("t")).alias("c"))
    return own.select("doc_id", F.size("t").alias("n_tokens"), F.size("c").alias("n_content"), F.size(F.array_distinct("c")).alias("n_distinct"))


@query("SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || '; ' || p_type || ',' || p_brand || chr(10) || ' ;', '[;,\\r\\n]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM part")
def split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.concat("p_name", F.lit("; "), "p_type", F.lit(","), "p_brand", F.lit("\n ;"))
    return h.read(spark, sf_dir, "part").select("p_partkey", text.split_features(field).alias("parts"))


@query("""
    WITH w AS (SELECT item_id, i, x FROM (SELECT item_id, regexp_split_to_array(text, ' ') AS l FROM benchmark), unnest(l) WITH ORDINALITY AS u(x, i)),
    n AS (SELECT item_id, i, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM w), f AS (SELECT item_id, arg_min(x, i) AS x, min(i) AS i FROM n WHERE x <> '' GROUP BY item_id, lower(x))
    SELECT item_id, list(x ORDER BY i) AS words FROM f GROUP BY 1
""")
def dedupe_keep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.read(spark, sf_dir, "benchmark").select("item_id", text.dedupe_keep_order(F.split("text", " ")).alias("words"))


_GAP = "([^\\p{L}\\p{N}_]|[^\\p{L}\\p{N}_].{0,78}[^\\p{L}\\p{N}_])"
_LEXICON = "lexicon AS (SELECT DISTINCT array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 1 + item_id % 3), ' ') AS feature FROM benchmark)"


@query(f"""
    WITH {_LEXICON}, l AS (SELECT feature, string_split(feature, ' ') AS t FROM lexicon WHERE feature <> ''),
    d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
    w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM d)
    SELECT doc_id, feature FROM w JOIN l ON w.word = l.t[1] JOIN d USING (doc_id) WHERE CASE len(l.t)
        WHEN 2 THEN regexp_matches(d.t, '{_OPEN}' || l.t[1] || '{_GAP}' || l.t[2] || '{_SHUT}') OR regexp_matches(d.t, '{_OPEN}' || l.t[2] || '{_GAP}' || l.t[1] || '{_SHUT}')
        ELSE regexp_matches(d.t, '{_OPEN}' || l.t[1] || '{_SHUT}') AND (len(l.t) < 2 OR regexp_matches(d.t, '{_OPEN}' || l.t[2] || '{_SHUT}')) AND (len(l.t) < 3 OR regexp_matches(d.t, '{_OPEN}' || l.t[3] || '{_SHUT}')) END
""")
def feature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon features, the first one to three words of the benchmark's texts, in every document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    lexicon = h.read(spark, sf_dir, "benchmark").select(F.array_join(F.slice(words, F.lit(1), (1 + F.col("item_id") % 3).cast("int")), " ").alias("feature")).distinct().filter("feature <> ''")
    return selection.lexicon_matches(h.read(spark, sf_dir, "documents"), lexicon, "doc_id", "text")


_PHRASES = """
    turns AS (SELECT conv_id, role, list_filter(list_transform(regexp_split_to_array(text, '[;,\\r\\n]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM conversations WHERE role IN ('user', 'assistant')),
    phrases AS (SELECT DISTINCT conv_id, role, unnest(p) AS phrase FROM turns),
    tok AS (SELECT conv_id, role, phrase, list_distinct({content}) AS t FROM phrases)
""".replace("{content}", _content_sql("phrase"))


@query(f"""
    WITH {_PHRASES}, s AS (
        SELECT u.conv_id, u.phrase AS feature, a.phrase, len(list_intersect(u.t, a.t)) AS shared, len(u.t) + len(a.t) - len(list_intersect(u.t, a.t)) AS total
        FROM tok u JOIN tok a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant'
    ), m AS (SELECT *, CASE WHEN shared > 0 THEN 0.6::DOUBLE + 0.4::DOUBLE * shared / total ELSE 0 END AS sim FROM s),
    p AS (SELECT conv_id, avg(b) AS ps, avg((b >= 0.4::DOUBLE)::INT) AS ph FROM (SELECT conv_id, phrase, max(sim) AS b FROM m GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT conv_id, avg(b) AS rs, avg((b >= 0.4::DOUBLE)::INT) AS rh FROM (SELECT conv_id, feature, max(sim) AS b FROM m GROUP BY 1, 2) GROUP BY 1)
    SELECT conv_id, round(0.5::DOUBLE * ps + 0.5::DOUBLE * ph, 6) AS precision, round(0.5::DOUBLE * rs + 0.5::DOUBLE * rh, 6) AS recall,
        round(0.5::DOUBLE * CASE WHEN ps + rs > 0 THEN 2 * ps * rs / (ps + rs) ELSE 0 END + 0.5::DOUBLE * CASE WHEN ph + rh > 0 THEN 2 * ph * rh / (ph + rh) ELSE 0 END, 6) AS f1
    FROM p JOIN r USING (conv_id)
""")
def lexical_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of the user's turns against those of the assistant's."""
    turns = h.read(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    phrases = turns.select("conv_id", "role", F.explode(text.split_features(F.col("text"))).alias("phrase")).distinct().withColumn("t", F.array_distinct(text.content_tokens(F.col("phrase"))))
    u = phrases.filter("role = 'user'").select("conv_id", F.col("phrase").alias("feature"), F.col("t").alias("tf"))
    a = phrases.filter("role = 'assistant'").select("conv_id", "phrase", F.col("t").alias("tp"))
    sims = u.join(a, "conv_id").withColumn("similarity", scalars.lexical_similarity(F.col("tf"), F.col("tp")))
    out = matching.soft_hard_prf(sims, "conv_id")
    return out.select("conv_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""
    WITH w AS (SELECT conv_id, coalesce(list_distinct(flatten(list({_content_sql('text')}) FILTER (role = 'assistant'))), []) AS p, coalesce(list_distinct(flatten(list({_content_sql('text')}) FILTER (role = 'user'))), []) AS t FROM conversations GROUP BY 1),
    m AS (SELECT conv_id, len(t) AS nt, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(p, t))::DOUBLE / len(p) END AS precision, len(list_intersect(p, t))::DOUBLE / nullif(len(t), 0) AS recall FROM w)
    SELECT conv_id, CASE WHEN nt > 0 THEN round(precision, 6) END AS precision, CASE WHEN nt > 0 THEN round(recall, 6) END AS recall,
        CASE WHEN nt > 0 THEN round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) END AS f1 FROM m
""")
def set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "conversations").withColumn("w", text.content_tokens(F.col("text")))
    of = lambda role: F.flatten(F.collect_list(F.when(F.col("role") == role, F.col("w"))))
    g = c.groupBy("conv_id").agg(of("assistant").alias("p"), of("user").alias("t"))
    p, r, f1 = text.set_prf(F.col("p"), F.col("t"))
    return g.select("conv_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


_SIMS = """
    sims AS (
        SELECT f.label AS doc, f.vec_id AS feature, p.vec_id AS phrase, list_dot_product(f.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS similarity
        FROM embeddings f JOIN embeddings p ON f.label = p.label AND f.vec_id % 2 = 0 AND p.vec_id % 2 = 1
    )
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Within each label as document, vectors of even ids in the part of features and those of odd ids in that of phrases: (doc, item, v) of each."""
    e = h.read(spark, sf_dir, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return e.filter("item % 2 = 0"), e.filter("item % 2 = 1")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, item, partner, similarity): each feature's best phrase."""
    features, phrases = _sides(spark, sf_dir)
    return nearest.best_partners(features, phrases.withColumnRenamed("item", "partner"))


_PRF_SQL = """
    p AS (SELECT doc, avg(b) AS ps, avg((b >= 0.4::DOUBLE)::INT) AS ph FROM (SELECT doc, phrase, max(similarity) AS b FROM {t} GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT doc, avg(b) AS rs, avg((b >= 0.4::DOUBLE)::INT) AS rh FROM (SELECT doc, feature, max(similarity) AS b FROM {t} GROUP BY 1, 2) GROUP BY 1)
    SELECT doc, round(0.5::DOUBLE * ps + 0.5::DOUBLE * ph, 6) AS precision, round(0.5::DOUBLE * rs + 0.5::DOUBLE * rh, 6) AS recall,
        round(0.5::DOUBLE * CASE WHEN ps + rs > 0 THEN 2 * ps * rs / (ps + rs) ELSE 0 END + 0.5::DOUBLE * CASE WHEN ph + rh > 0 THEN 2 * ph * rh / (ph + rh) ELSE 0 END, 6) AS f1
    FROM p JOIN r USING (doc)
"""


@query(f"WITH {_SIMS}, {_PRF_SQL.format(t='sims')}")
def soft_hard_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.prf_of_vectors(*_sides(spark, sf_dir))
    return out.select("doc", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""
    WITH {_SIMS}, c AS (SELECT doc, phrase, max(similarity) AS b FROM sims GROUP BY 1, 2), k AS (SELECT doc, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY b DESC, phrase) AS r, count(*) OVER (PARTITION BY doc) AS n FROM c) WHERE r <= greatest(1, floor(0.5::DOUBLE * n))),
    few AS (SELECT s.* FROM sims s JOIN k USING (doc, phrase)), {_PRF_SQL.format(t='few')}
""")
def topk_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.prf_of_vectors(*_sides(spark, sf_dir), matching.SHARES["p50"])
    return out.select("doc", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_SIMS} SELECT doc, feature, phrase AS best_phrase, round(similarity, 6) AS best_similarity, similarity >= 0.4::DOUBLE AS covered FROM (SELECT *, row_number() OVER (PARTITION BY doc, feature ORDER BY similarity DESC, phrase) AS r FROM sims) WHERE r = 1")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("doc", F.col("item").alias("feature"), F.col("partner").alias("best_phrase"), F.round("similarity", 6).alias("best_similarity"), (F.col("similarity") >= matching.THRESHOLD).alias("covered"))


@query(f"""
    WITH {_SIMS}, b AS (SELECT doc, feature, max(similarity) AS best FROM sims GROUP BY 1, 2)
    SELECT doc, round(avg(1 - acos(greatest(-1, least(1, best))) / pi()), 6) AS kg_faithfulness, avg((best >= 0.35::DOUBLE)::INT) AS grounding_ratio, round(avg(best), 6) AS mean_similarity, round(quantile_cont(best, 0.5), 6) AS median_similarity FROM b GROUP BY 1
""")
def kg_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.faithfulness(_best(spark, sf_dir), sentence="item")
    return out.select("doc", F.round("kg_faithfulness", 6).alias("kg_faithfulness"), "grounding_ratio", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("median_similarity", 6).alias("median_similarity"))


@query("""
    WITH w AS (SELECT doc_id, lower(text) AS t, length(trim(text)) AS n FROM documents)
    SELECT doc_id, round(0.35::DOUBLE * CASE WHEN regexp_matches(t, '(?:^|\\n)\\s*[1-8]\\s*\\)') THEN 1 ELSE 0 END
        + 0.25::DOUBLE * CASE WHEN len(list_filter(list_slice(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1, 40), lambda x: x LIKE '%:')) >= 2 THEN 1 ELSE 0 END
        + 0.2::DOUBLE * CASE WHEN len(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x LIKE '- %' OR x LIKE '* %' OR x LIKE '•%')) > 0 THEN 1 ELSE 0 END
        + 0.2::DOUBLE * least(1, n / 800::DOUBLE), 6) AS score FROM w
""")
def structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.read(spark, sf_dir, "documents").select("doc_id", F.round(text.structural_score(F.col("text")), 6).alias("score"))


@query("""
    WITH p AS (SELECT conv_id, turn, 'Required format: evidence and caveat. ' || text AS ask, text FROM conversations)
    SELECT conv_id, turn, round(0.2::DOUBLE + 0.55::DOUBLE * (contains(lower(text), 'evidence')::INT + contains(lower(text), 'caveat')::INT
        + CASE WHEN contains(lower(ask), 'mechanistic summary') THEN contains(lower(text), 'mechanistic summary')::INT ELSE 0 END) / (2 + contains(lower(ask), 'mechanistic summary')::INT), 6) AS score FROM p
""")
def heuristic_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "conversations")
    ask = F.concat(F.lit("Required format: evidence and caveat. "), "text")
    return c.select("conv_id", "turn", F.round(text.heuristic_format(F.col("text"), ask), 6).alias("score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n``` {not json}"))
    return h.read(spark, sf_dir, "events").select("event_id", F.get_json_object(text.json_object(wrapped), "$.k").cast("long").alias("k"))


@query("""
    WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS s FROM conversations)
    SELECT conv_id, turn, md5(CASE WHEN length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) >= 60 THEN s ELSE '1) Overview' || chr(10) || '2) Mechanistic Summary ' || s || chr(10) || '3) Evidence' END) AS digest FROM t
""")
def mechanistic_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    answer = F.concat(F.lit("1) Overview\n2) Mechanistic Summary "), s, F.lit("\n3) Evidence"))
    return h.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.mechanistic_section(answer)).alias("digest"))


@query("SELECT page_id, substr(sha256(html), 1, 16) AS h FROM pages")
def hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.read(spark, sf_dir, "pages").select("page_id", scalars.hash_text(F.col("html")).alias("h"))


def _mmr_sql(k: int) -> str:
    parts = ["""
    WITH v AS (SELECT label AS grp, vec_id AS item, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
    q AS (SELECT grp, arg_min(v, item) AS q FROM v GROUP BY 1), l0 AS MATERIALIZED (SELECT grp, item, v, round(list_dot_product(v, q), 9) AS rel, 0::DOUBLE AS near FROM v JOIN q USING (grp)),
    c1 AS MATERIALIZED (SELECT grp, item, v FROM l0 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rel DESC, item) = 1),
    l1 AS MATERIALIZED (SELECT l.grp, l.item, l.v, rel, round(list_dot_product(l.v, c.v), 9) AS near FROM l0 l JOIN c1 c ON c.grp = l.grp AND c.item <> l.item)"""]
    for i in range(2, k + 1):
        parts.append(f"""
    c{i} AS MATERIALIZED (SELECT grp, item, v FROM l{i - 1} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY 0.7::DOUBLE * rel - (1 - 0.7::DOUBLE) * near DESC, item) = 1),
    l{i} AS MATERIALIZED (SELECT l.grp, l.item, l.v, rel, greatest(near, round(list_dot_product(l.v, c.v), 9)) AS near FROM l{i - 1} l JOIN c{i} c ON c.grp = l.grp AND c.item <> l.item)""")
    return ",".join(parts) + "\n    " + " UNION ALL ".join(f"SELECT grp, item, {i}::INT AS rank FROM c{i}" for i in range(1, k + 1))


@query(_mmr_sql(10))
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most relevant and diverse vectors of each label for the label's first vector."""
    e = h.read(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    asked = e.groupBy(F.col("label").alias("grp")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return selection.mmr(e.select(F.col("label").alias("grp"), F.col("vec_id").alias("item"), "embedding"), asked, 10)


@query(f"""
    WITH RECURSIVE {_SIMS}, worst AS (SELECT doc, feature, max(similarity) AS best FROM sims GROUP BY 1, 2)
    SELECT doc, feature, rank FROM (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY best, feature))::INT AS rank FROM worst) WHERE rank <= 6
""")
def worst_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir).select("doc", F.col("item").alias("feature"), "similarity")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("similarity", "feature"))).filter("rank <= 6").select("doc", "feature", "rank")


@query("""
    SELECT l_orderkey, l_linenumber, n, format('{:.6g}', x) AS told FROM (
        SELECT l_orderkey, l_linenumber, unnest([1, 2, 3, 4]) AS n, unnest([l_extendedprice, l_discount / 7, l_extendedprice * 1e4, -l_tax / 1e5]) AS x FROM lineitem
    )
""")
def general_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of many sizes with six significant digits."""
    x = F.array(F.col("l_extendedprice"), F.col("l_discount") / 7, F.col("l_extendedprice") * 1e4, -F.col("l_tax") / 1e5)
    rows = h.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(x).alias("n", "x"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("n") + 1).alias("n"), scalars.general(F.col("x")).alias("told"))


def _nine(x: str) -> str:
    """SQL for a double of a few digits before its point, rounded half away from zero to nine decimals as it is written; DuckDB's round takes it times 1e9 first, so that what lies just below a half can become one."""
    return f"CASE WHEN isfinite({x}) THEN round({x}::VARCHAR::DECIMAL(38, 28), 9)::DOUBLE ELSE {x} END"


@query(f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
    u AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN n > 1e-9 THEN x / n ELSE 0 END) AS u, 1 / (1 + exp(-greatest(-60::DOUBLE, least(60::DOUBLE, (v[1] - 0.1) / 0.05)))) AS s FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v))
    SELECT vec_id, list_transform(u, lambda x: {_nine("x")}) AS unit, {_nine("s")} AS squashed FROM u
""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector at unit length, and its first component through a logistic function."""
    v = h.read(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    return v.select("vec_id", F.transform(scalars.l2_normalized(F.col("embedding")), lambda x: F.round(x, 9)).alias("unit"), F.round(scalars.sigmoid(F.get("embedding", F.lit(0)).cast("double"), 0.1, 0.05), 9).alias("squashed"))
