"""Evaluation payloads: rows of metrics from nested documents, resuming, file names, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, text

#: Columns of the evaluation table and where a payload holds them.
METRICS = {
    "f1_raw": "feature_embed_f1_raw", "f1_raw_full": "feature_embed_f1_raw_full", "f1_raw_topk_p50": "feature_embed_f1_raw_topk_p50", "f1_raw_topk_p75": "feature_embed_f1_raw_topk_p75",
    "precision_raw": "feature_embed_precision_raw", "recall_raw": "feature_embed_recall_raw", "grounded_score": "grounded_feature_score",
}
CHECKS = {
    "faithfulness": "faithfulness_score", "kg_faithfulness": "kg_faithfulness", "hallucination_score": "hallucination_score", "total_similarity": "total_embedding_similarity",
    "format_score": "format_score", "citation_count": "citation_count",
}


def _parts(path: Column) -> Column:
    return F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.json$", ""), "_")


def model_of(path: Column) -> Column:
    """The model that a payload's file name tells: what follows the pair, and the word naive."""
    p = _parts(path)
    skip = F.when((F.lower(F.get(p, F.lit(2))) == "naive") & (F.size(p) >= 4), 4).otherwise(3)
    return F.when(F.size(p) >= 3, F.array_join(F.slice(p, skip, F.size(p)), "_"))


def pair_of(path: Column) -> Column:
    p = _parts(path)
    return F.when(F.size(p) >= 3, F.struct(F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b")))


def is_naive(path: Column) -> Column:
    return F.contains(F.lower(F.element_at(F.split(path, "/"), -1)), F.lit("_naive_"))


def payload_rows(payloads: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(gene_a, gene_b, model, strategy, metrics...) of payloads given as JSON text: each strategy but prompt, and of naive payloads the baseline as naive. Broken JSON gives no rows."""
    metrics = F.from_json(F.get_json_object(F.col(content), "$.metrics"), "map<string,string>")
    rows = payloads.select(pair_of(F.col(path)).alias("p"), model_of(F.col(path)).alias("model"), is_naive(F.col(path)).alias("naive"), F.explode(metrics).alias("strategy", "m"))
    rows = rows.filter(F.col("p").isNotNull() & F.when(F.col("naive"), F.col("strategy") == "baseline").otherwise(F.col("strategy") != "prompt") & F.startswith(F.ltrim("m"), F.lit("{")))
    number = lambda p: F.get_json_object("m", p).try_cast("double")
    return rows.select(
        F.col("p.a").alias("gene_a"), F.col("p.b").alias("gene_b"), "model", F.when(F.col("naive"), "naive").otherwise(F.col("strategy")).alias("strategy"),
        *(number(f"$.{k}").alias(c) for c, k in METRICS.items()), *(number(f"$.checks.{k}").alias(c) for c, k in CHECKS.items()),
    )


def todo(pairs: DataFrame, done: DataFrame, on: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Pairs that are not done yet, by the unordered pair: a batch that can be resumed any time."""
    key = lambda df: df.withColumn("_k", F.concat_ws("/", F.least(F.upper(on[0]), F.upper(on[1])), F.greatest(F.upper(on[0]), F.upper(on[1]))))
    return key(pairs).join(key(done).select("_k"), "_k", "left_anti").drop("_k")


def ground_truth(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(a, b, features, explanation): the last row of each ordered pair, in upper case."""
    last = rows.groupBy(F.upper(F.trim("geneA")).alias("a"), F.upper(F.trim("geneB")).alias("b")).agg(F.max_by(F.struct("important_features", "explanation"), seq).alias("t"))
    return last.select("a", "b", text.split_features(F.col("t.important_features")).alias("features"), F.col("t.explanation").alias("explanation"))


def prompt_parts(messages: DataFrame, fallback: str) -> DataFrame:
    """(id, system, prompt): the first system and user message of each prompt (id, messages array<struct<role, content>>), a general prompt where there is none."""
    first = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    return messages.select("id", first("system").alias("system"), F.coalesce(F.when(F.trim(first("user")) != "", first("user")), F.lit(fallback)).alias("prompt"))


def prompt_tables(nodes: DataFrame, edges: DataFrame, top_nodes: int = 30, top_edges: int = 40) -> DataFrame:
    """(pair_id, nodes_table, edges_table): tab-separated lines of each pair's best nodes and edges, for prompts."""
    best = lambda df, order, n, line: df.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy(*order))).filter(F.col("_r") <= n).groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    n = best(nodes, (F.desc("node_score"), "node"), top_nodes, F.concat_ws("\t", "node", "type", F.format_string("%.4f", "node_score")))
    e = best(edges, (F.desc("evidence"), "src", "dst", "key"), top_edges, F.concat_ws("\t", "src", "dst", "type", "source", F.concat(F.lit("key="), F.col("key").cast("string")), F.format_string("%.4f", "evidence")))
    return n.withColumnRenamed("t", "nodes_table").join(e.withColumnRenamed("t", "edges_table"), "pair_id", "full")


def evidence_lines(rows: DataFrame, columns: tuple[str, ...], order: tuple, most: int, name: str) -> DataFrame:
    """(pair_id, <name>_cols, <name>_lines): the header of these columns and a line for each of a pair's first ``most`` rows in the order; numbers with six significant digits, nulls as empty texts, line ends and bars as blanks."""

    def cell(c: str):
        kind = rows.schema[c].dataType.simpleString()
        told = scalars.general(F.col(c).cast("double")) if kind in ("double", "float") or kind.startswith("decimal") else F.col(c).cast("string")
        return F.coalesce(F.regexp_replace(told, r"[\r\n|]", " "), F.lit(""))

    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy(*order))).filter(F.col("_r") <= most)
    lines = best.select("pair_id", F.struct("_r", F.concat_ws(" | ", *(cell(c) for c in columns)).alias("l")).alias("l")).groupBy("pair_id").agg(F.array_sort(F.collect_list("l")).alias("l"))  # most rows of a pair
    return lines.select("pair_id", F.lit(" | ".join(columns)).alias(f"{name}_cols"), F.array_join(F.transform("l", lambda x: x["l"]), "\n").alias(f"{name}_lines"))


def filled(template: str, **values) -> Column:
    """A template with the fields {name} replaced, each once for all and none inside what another has brought in."""
    parts, out = re.split(r"\{(\w+)\}", template), []
    for i, x in enumerate(parts):
        out.append(F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 and x in values else F.lit(f"{{{x}}}" if i % 2 else x))
    return F.concat(*out)


def prompt_messages(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, system: str, user: str) -> DataFrame:
    """(id, messages) of pairs (pair_id, a, b): a system and a user template with gene_a, gene_b, and the header and lines (node_cols, node_lines, edge_cols, edge_lines) of the evidence of both tables, as evidence_lines gives them."""
    told = pairs.join(nodes, "pair_id", "left").join(edges, "pair_id", "left")
    values = {"gene_a": F.col("a"), "gene_b": F.col("b"), **{f"{x}_{y}": F.col(f"{x}_{y}") for x in ("node", "edge") for y in ("cols", "lines")}}
    message = lambda role, text: F.struct(F.lit(role).alias("role"), filled(text, **values).alias("content"))
    return told.select(F.col("pair_id").alias("id"), F.array(message("system", system), message("user", user)).alias("messages"))


def score_texts(rows: DataFrame) -> DataFrame:
    """rows (id, text, context, features, explanation) with the checks that need no model: citations, format, structure, features found."""
    found = F.filter("features", lambda f: text.contains_feature(F.col("text"), f))
    gold = F.filter(F.transform(F.coalesce("features", F.expr("cast(array() as array<string>)")), text.normalize), lambda f: f != "")
    p, r, f1 = text.set_prf(found, gold)
    expected = text.citations_expected(F.col("context"))
    return rows.withColumns({
        "citation_count": text.citation_count(F.col("text")), "citation_keys": text.citation_keys(F.col("text")), "format_score": text.heuristic_format(F.col("text"), F.col("context")),
        "structural_score": text.structural_score(F.col("text")), "grounding_ok": expected & (text.citation_count(F.col("text")) >= 2), "precision": p, "recall": r, "f1": f1,
        "hallucination_score": F.when(F.coalesce("explanation", F.lit("")) == "", 1.0),
    })


def payloads(rows: DataFrame) -> DataFrame:
    """(id, payload): the JSON document of each answered prompt (id, a, b, prompt, model, features, explanation, texts map) before it is scored."""
    truth = F.struct((F.trim(F.coalesce("explanation", F.lit(""))) != "").alias("available"), F.coalesce("features", F.expr("cast(array() as array<string>)")).alias("features"), F.coalesce("explanation", F.lit("")).alias("explanation"))
    whole = F.struct(F.col("a").alias("gene_a"), F.col("b").alias("gene_b"), F.substring(F.sha2(F.coalesce("prompt", F.lit("")), 256), 1, 16).alias("prompt_hash"), F.struct(F.col("model").alias("name")).alias("model"), truth.alias("ground_truth"), "texts")
    return rows.select("id", F.to_json(whole).alias("payload"))
