"""Queries of the model-backed and evaluation operators, with the offline models, and of whole explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import evaluation, graph, judging, models, strategies
from . import explain
from . import harness as h
from .registry import query


@query("""
    WITH p AS (SELECT 'x/' || c_custkey || '_' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '_naive' ELSE '' END || '_m_' || c_mktsegment || '.json' AS path, c_custkey % 3 = 0 AS naive, c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer)
    SELECT c_custkey::VARCHAR AS gene_a, c_nationkey::VARCHAR AS gene_b, 'm_' || c_mktsegment AS model, CASE WHEN naive THEN 'naive' ELSE s END AS strategy, c_acctbal AS f1_raw, 0.5::DOUBLE AS faithfulness
    FROM p, unnest(['baseline', 'cove']) AS u(s) WHERE NOT naive OR s = 'baseline'
""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "customer")
    path = F.concat(F.lit("x/"), "c_custkey", F.lit("_"), "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "_naive").otherwise(""), F.lit("_m_"), "c_mktsegment", F.lit(".json"))
    m = F.struct(F.col("c_acctbal").alias("feature_embed_f1_raw"), F.struct(F.lit(0.5).alias("faithfulness_score")).alias("checks"))
    content = F.to_json(F.struct(F.struct(m.alias("baseline"), m.alias("cove"), F.lit("text").alias("prompt")).alias("metrics")))
    return evaluation.payload_rows(c.select(path.alias("path"), content.alias("content"))).select("gene_a", "gene_b", "model", "strategy", "f1_raw", "faithfulness")


@query("""
    WITH p AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), d AS (SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R')
    SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.a = upper(p.b) AND d.b = upper(p.a))
""")
def completed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = h.read(spark, sf_dir, "lineitem")
    pairs = li.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    done = li.filter("l_returnflag = 'R'").select(F.concat(F.lit("P"), "l_partkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b")).distinct()
    return evaluation.todo(pairs, done)


@query("""
    WITH l AS (SELECT upper(trim(l_returnflag)) AS a, upper(trim(l_linestatus || l_linenumber)) AS b, max(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2)
    SELECT a, b, ['x' || seq, 'y'] AS features FROM l
""")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = h.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("geneA"), F.concat("l_linestatus", "l_linenumber").alias("geneB"), F.concat(F.lit("x"), "l_orderkey", F.lit("; y,")).alias("important_features"), F.lit("").alias("explanation"), F.col("l_orderkey").alias("seq"))
    return evaluation.ground_truth(rows).select("a", "b", "features")


@query()
def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "conversations")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit("Required format: evidence, citation of the kg by key=").alias("context"), F.slice(F.split("text", " "), 1, 5).alias("features"), F.lit(None).cast("string").alias("explanation"))
    return evaluation.score_texts(rows).drop("text", "features")


@query()
def chain_of_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return strategies.chain_of_verification(c)


@query()
def self_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return strategies.self_refine(c)


@query()
def total_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it, as whole texts."""
    c = models.embedded(h.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("embedding").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(scalars.clamp01(scalars.dot(F.col("embedding"), F.col("before"))), 6).alias("similarity"))


@query()
def nli_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the assistant's turns against chunks of the user's."""
    c = h.read(spark, sf_dir, "conversations")
    premise = c.filter("role = 'user'").select("conv_id", F.explode(text.chunks(F.col("text"))).alias("premise"))
    sentence = c.filter("role = 'assistant'").select(F.col("conv_id"), F.explode(F.slice(text.sentences(F.col("text")), 1, text.MAX_SENTENCES)).alias("sentence")).distinct()
    scored = models.nli_scores(sentence.join(premise, "conv_id").withColumnRenamed("conv_id", "doc"), "premise", "sentence")
    return models.nli_faithfulness(scored)


@query()
def keyphrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = models.keyphrases(h.read(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return c.select("item_id", text.filter_candidates(F.col("phrases"), F.array(F.element_at(F.split("text", " "), 1))).alias("phrases"))


def _explained(spark: SparkSession, sf_dir: str) -> explain.Explanation:
    return explain.explain(h.nodes(spark, sf_dir), h.edges(spark, sf_dir), h.pairs(spark, sf_dir), explain.Settings(priority=h.PRIORITY))


@query()
def explained_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).nodes


@query()
def explained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).edges


@query()
def explained_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.explain_pairs(h.nodes(spark, sf_dir), h.edges(spark, sf_dir), h.pairs(spark, sf_dir), priority=h.PRIORITY)


@query("""
    SELECT conv_id || '-' || turn AS id, substr(sha256(text), 1, 16) AS hash, length(text) > 0 AS available FROM conversations
""")
def payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "conversations")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("A").alias("a"), F.lit("B").alias("b"), F.col("text").alias("prompt"), F.lit("m").alias("model"), F.array("role").alias("features"), F.col("text").alias("explanation"), F.create_map(F.lit("baseline"), F.col("text")).alias("texts"))
    p = evaluation.payloads(rows)
    return p.select("id", F.get_json_object("payload", "$.prompt_hash").alias("hash"), F.get_json_object("payload", "$.ground_truth.available").cast("boolean").alias("available"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers: the user's turn is the context, its first words the features, the turn before the explanation."""
    c = h.read(spark, sf_dir, "conversations")
    own, before = c.filter("role = 'assistant'"), c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    features = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array_join(F.slice(F.split("asked", " "), 2 * i - 1, 2), " "))
    return own.join(before, ["conv_id", "turn"], "left").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.coalesce("asked", F.lit("")).alias("context"), F.when(F.col("asked").isNotNull(), features).alias("features"), F.col("asked").alias("explanation"))


@query()
def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, structure and grounding of answers."""
    return judging.format_checks(_answers(spark, sf_dir))


@query()
def faithfulness_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against their explanations, and back."""
    return judging.faithfulness(_answers(spark, sf_dir))


@query()
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of answers."""
    return judging.text_metrics(_answers(spark, sf_dir))


@query()
def rescored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of two answers each, scored again."""
    a = _answers(spark, sf_dir).withColumn("n", F.split("id", "-"))
    path = F.concat(F.lit("x/"), F.get("n", F.lit(0)), F.lit("_"), F.get("n", F.lit(1)), F.lit("_m.json"))
    truth = F.struct("features", F.coalesce("explanation", F.lit("")).alias("explanation"))
    texts = F.create_map(F.lit("prompt"), F.col("context"), F.lit("baseline"), F.col("text"), F.lit("cove"), F.upper("text"), F.lit("blank"), F.lit(" "))
    return judging.rescored(a.select(path.alias("path"), F.to_json(F.struct(truth.alias("ground_truth"), texts.alias("texts"))).alias("content")))


@query(f"""
    WITH {h.EDGES_SQL}, {h.NODES_SQL}, {h.PAIRS_SQL}, c AS (SELECT pair_id, a AS node FROM pairs UNION SELECT pair_id, b FROM pairs),
    e AS (SELECT pair_id, src, dst, type, source, key, evidence FROM edges JOIN c ON src = node UNION SELECT pair_id, src, dst, type, source, key, evidence FROM edges JOIN c ON dst = node),
    el AS (
        SELECT pair_id, string_agg(src || ' | ' || dst || ' | ' || type || ' | ' || source || ' | ' || key || ' | ' || format('{{:.6g}}', evidence), chr(10) ORDER BY r) AS l
        FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY evidence DESC, src, dst, key) AS r FROM e) WHERE r <= 12 GROUP BY 1
    ), nl AS (SELECT pair_id, string_agg(node || ' | ' || type || ' | ' || symbol, chr(10) ORDER BY node) AS l FROM c JOIN nodes ON node_id = node GROUP BY 1)
    SELECT p.pair_id AS id, 'Explain ' || a || ' and ' || b || ' by {{edges}} only.' AS system,
        a || ' / ' || b || chr(10) || 'node | type | symbol' || chr(10) || coalesce(nl.l, '') || chr(10) || 'src | dst | type | source | key | evidence' || chr(10) || coalesce(el.l, '') AS prompt
    FROM pairs p LEFT JOIN nl USING (pair_id) LEFT JOIN el USING (pair_id)
""")
def prompt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all pairs: the ends as nodes, and the twelve links of the best evidence at either end."""
    pairs, edges = h.pairs(spark, sf_dir), h.edges(spark, sf_dir).select("src", "dst", "type", "source", "key", "evidence")
    cores = pairs.select("pair_id", F.explode(F.array("a", "b")).alias("node"))
    best = (F.desc("evidence"), "src", "dst", "key")
    near = graph.first_incident(edges, cores, 12, *best)
    ends = cores.join(h.nodes(spark, sf_dir).withColumnRenamed("node_id", "node"), "node")
    node_lines = evaluation.evidence_lines(ends, ("node", "type", "symbol"), ("node",), 30, "node")
    edge_lines = evaluation.evidence_lines(near, ("src", "dst", "type", "source", "key", "evidence"), best, 12, "edge")
    told = evaluation.prompt_messages(pairs, node_lines, edge_lines, "Explain {gene_a} and {gene_b} by {edges} only.", "{gene_a} / {gene_b}\n{node_cols}\n{node_lines}\n{edge_cols}\n{edge_lines}")
    return evaluation.prompt_parts(told, "none")
