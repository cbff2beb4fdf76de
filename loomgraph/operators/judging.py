"""Scoring answers as a whole: format, faithfulness both ways, features found, and the table of metrics, also for payloads that are scored again.

Each score is a table keyed by the answers' id; models come as objects behind the protocols of ``models`` and are called on the executors, batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..runtime import saved
from . import evaluation, matching, models

#: What an explanation should contain, as it is embedded, and how likeness to it counts.
COMPONENTS = (
    ("mechanism", "Mechanistic explanation linking gene A and gene B (pathway/causal chain)."),
    ("evidence", "Evidence description (supporting interactions, references, or concrete support)."),
    ("direction", "Directionality or effect description (activates/inhibits, up/down, increases/decreases)."),
    ("context", "Biological context / assumptions (cell type, condition, scope, caveats about context)."),
    ("caveats", "Limitations / uncertainty / alternative hypotheses."),
    ("validation", "Suggested validation (experiments, perturbations, checks, follow-ups)."),
)
LEAST_LIKENESS, LIKENESS_SPAN, COVERAGE_SHARE, PARAGRAPH = 0.25, 0.35, 0.75, 600
LEAST_CITATIONS, LEAST_COMPLIANCE, TRUTH_SENTENCE = 2, 0.5, 15

_NO_TEXTS = "cast(array() as array<string>)"


def component_coverage(rows: DataFrame, model: models.Embedder | None = None) -> DataFrame:
    """(id, component_coverage): for each expected component the paragraph most like it, scaled, averaged over the components. rows: id, text."""
    model = model or models.HashedNgrams()
    whole = F.trim(F.coalesce("text", F.lit("")))
    parts = text.paragraphs(F.col("text"))
    parts = F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(whole)), lambda p: F.substring(p, 1, PARAGRAPH))
    seen = models.embedded(rows.filter(whole != "").select("id", F.explode(parts).alias("part")), "part", "_v", model)
    vectors = model.embed([d for _, d in COMPONENTS])
    like = {name: scalars.dot(F.col("_v"), F.lit([float(x) for x in v])) for (name, _), v in zip(COMPONENTS, vectors, strict=True)}
    best = seen.groupBy("id").agg(*(F.greatest(F.lit(0.0), F.max(c)).alias(n) for n, c in like.items()))
    scaled = [scalars.clamp01((F.col(n) - LEAST_LIKENESS) / LIKENESS_SPAN) for n, _ in COMPONENTS]
    return best.select("id", (sum(scaled[1:], scaled[0]) / F.lit(float(len(scaled)))).alias("component_coverage"))


def format_checks(rows: DataFrame, model: models.Embedder | None = None) -> DataFrame:
    """(id, format_score, component_coverage, structural_score, structural_compliance, citation_count, unique_citation_count, grounding_ok) of answers (id, text, context).

    The format score is three quarters of component coverage and one of structure; an answer without text has 0. Grounding needs citations that were asked for and half of the sections.
    """
    t = F.col("text")
    facts = rows.select("id", text.structural_score(t).alias("structural_score"), text.structural_compliance(t).alias("structural_compliance"), text.citation_count(t).alias("citation_count"), text.citation_keys(t).alias("unique_citation_count"), text.grounding_asked(F.col("context")).alias("_asked"))
    both = facts.join(component_coverage(rows, model), "id", "left").fillna(0.0, ["component_coverage"])
    score = scalars.clamp01(COVERAGE_SHARE * F.col("component_coverage") + (1 - COVERAGE_SHARE) * F.col("structural_score"))
    grounded = F.col("_asked") & (F.col("citation_count") >= LEAST_CITATIONS) & (F.col("structural_compliance") >= LEAST_COMPLIANCE)
    return both.select("id", score.alias("format_score"), "component_coverage", "structural_score", "structural_compliance", "citation_count", "unique_citation_count", grounded.alias("grounding_ok"))


def _one_way(rows: DataFrame, premise, hypotheses, model: models.NliScorer | None) -> DataFrame:
    """(id, faithfulness) of the hypotheses of each row against the chunks of its premise; each sentence counts by its place, so repeated ones count each."""
    chunks = rows.select("id", F.explode(text.chunks(premise)).alias("premise"))
    sentences = rows.select("id", F.posexplode(F.slice(hypotheses, 1, text.MAX_SENTENCES)).alias("sentence", "hypothesis"))
    # A text has few chunks and at most MAX_SENTENCES sentences: the pairs of one answer are bounded by its own length.
    scored = models.nli_scores(sentences.join(chunks, "id"), "premise", "hypothesis", model)
    return models.nli_faithfulness(scored, "id", "sentence").select("id", "faithfulness")


def faithfulness(rows: DataFrame, model: models.NliScorer | None = None) -> DataFrame:
    """(id, forward, reverse, gt_faithfulness, hallucination_score) of answers (id, text, explanation).

    Forward, the answer's mechanistic section is held against the explanation; in reverse, the explanation's sentences against the answer without citations; the score is their mean. Without an
    explanation, or without sentences, it is 0, and hallucination is its complement. An explanation without sentences of its own counts forward only.
    """
    t, e = F.col("text"), F.coalesce(F.trim("explanation"), F.lit(""))
    have = rows.filter(e != "").select("id", "text", e.alias("explanation"))
    section = text.sentences(text.mechanistic_section(t))
    forward = _one_way(have, F.col("explanation"), F.when(F.size(section) > 0, section).otherwise(text.sentences(t)), model).withColumnRenamed("faithfulness", "forward")
    reverse = _one_way(have, text.strip_citations(t), text.sentences(F.col("explanation"), TRUTH_SENTENCE), model).withColumnRenamed("faithfulness", "reverse")
    both = rows.select("id").join(forward, "id", "left").join(reverse, "id", "left")
    mean = F.when(F.col("forward").isNull(), 0.0).otherwise(scalars.clamp01(0.5 * F.col("forward") + 0.5 * F.coalesce("reverse", "forward")))
    return both.select("id", "forward", "reverse", mean.alias("gt_faithfulness"), (1 - mean).alias("hallucination_score"))


def feature_pairs(rows: DataFrame, embedder: models.Embedder | None = None, extractor: models.KeyphraseExtractor | None = None) -> DataFrame:
    """(doc, feature, phrase, similarity) of every truth feature with every candidate phrase of its own answer (id, text, features)."""
    primary = rows.select("id", F.coalesce("features", F.expr(_NO_TEXTS)).alias("features"), text.primary_text(F.col("text")).alias("_t"))
    found = models.keyphrases(primary, "_t", extractor)
    phrases = text.filter_candidates(F.concat(F.coalesce(text.explicit_phrases(F.col("_t")), F.expr(_NO_TEXTS)), "phrases"), F.col("features"))
    p = models.embedded(found.select(F.col("id").alias("doc"), F.explode(phrases).alias("phrase")), "phrase", "_p", embedder)
    f = models.embedded(primary.select(F.col("id").alias("doc"), F.explode(F.array_distinct(F.transform("features", text.normalize))).alias("feature")).filter("feature <> ''"), "feature", "_f", embedder)
    # Each text is split once and not for every pair that it is in.
    p, f = p.withColumn("_pt", text.content_tokens(F.col("phrase"))), f.withColumn("_ft", text.content_tokens(F.col("feature")))
    like = scalars.adjusted_similarity(scalars.dot(F.col("_f"), F.col("_p")), F.col("_ft"), F.col("_pt"))
    return f.join(p, "doc").select("doc", "feature", "phrase", like.alias("similarity"))


def kg_faithfulness(rows: DataFrame, embedder: models.Embedder | None = None) -> DataFrame:
    """(id, kg_faithfulness): the sentences of answers (id, text, context) against the sentences that their context's edges make."""
    s = models.embedded(rows.select("id", F.posexplode(F.slice(text.sentences(F.col("text")), 1, text.MAX_SENTENCES)).alias("sentence", "_s")), "_s", "_a", embedder)
    k = models.embedded(rows.select("id", F.explode(text.kg_sentences(F.col("context"))).alias("_k")), "_k", "_b", embedder)
    sims = s.join(k, "id").select("id", "sentence", scalars.dot(F.col("_a"), F.col("_b")).alias("similarity"))
    return matching.faithfulness(sims, "id", "sentence").select("id", "kg_faithfulness")


def text_metrics(rows: DataFrame, embedder: models.Embedder | None = None, nli: models.NliScorer | None = None, extractor: models.KeyphraseExtractor | None = None) -> DataFrame:
    """All metrics of answers (id, text, context, features, explanation), a row for each id; ids must be distinct.

    f1_raw is the recall, by the reports' convention; what depends on features is null without them, total_similarity without an explanation. The gate is the format score of grounded answers
    with two citations, else 0. Answers and the pairs of features and phrases are saved, since each is read by several metrics and the pairs ask the models.
    """
    rows = saved(rows.select("id", "text", "context", "features", "explanation"), "metrics-answers")
    checks = format_checks(rows, embedder)
    pairs = saved(feature_pairs(rows, embedder, extractor), "metrics-pairs")
    prf = matching.soft_hard_prf(pairs).select(F.col("doc").alias("id"), "precision", "recall", "f1")
    tops = [matching.topk_prf(pairs, share).select(F.col("doc").alias("id"), F.col("f1").alias(f"f1_raw_topk_{name}")) for name, share in matching.SHARES.items()]
    truth = rows.filter(F.trim(F.coalesce("explanation", F.lit(""))) != "")
    alike = models.embedded(models.embedded(truth.select("id", "text", "explanation"), "text", "_a", embedder), "explanation", "_b", embedder)
    alike = alike.select("id", scalars.clamp01(scalars.dot(F.col("_a"), F.col("_b"))).alias("total_similarity"))
    whole = rows.select("id", (F.size(F.coalesce("features", F.expr(_NO_TEXTS))) > 0).alias("_has")).join(checks, "id").join(faithfulness(rows, nli), "id").join(kg_faithfulness(rows, embedder), "id", "left").join(alike, "id", "left").join(prf, "id", "left")
    for t in tops:
        whole = whole.join(t, "id", "left")
    for c in ("precision", "recall", "f1", *(f"f1_raw_topk_{n}" for n in matching.SHARES)):
        whole = whole.withColumn(c, F.when(F.col("_has"), F.coalesce(c, F.lit(0.0))))
    whole = whole.fillna(0.0, ["kg_faithfulness"])
    gate = F.when(F.col("grounding_ok") & (F.col("citation_count") >= LEAST_CITATIONS), F.col("format_score")).otherwise(F.lit(0.0))
    recall = F.coalesce("recall", F.lit(0.0))
    return whole.select(
        "id", recall.alias("f1_raw"), F.col("f1").alias("f1_raw_full"), "f1_raw_topk_p50", "f1_raw_topk_p75", F.col("precision").alias("precision_raw"), F.col("recall").alias("recall_raw"),
        scalars.grounded_score(recall, F.col("gt_faithfulness"), F.col("kg_faithfulness")).alias("grounded_score"), F.col("gt_faithfulness").alias("faithfulness"), "gt_faithfulness", "kg_faithfulness", "hallucination_score",
        "total_similarity", "format_score", "citation_count", "unique_citation_count", "grounding_ok", gate.alias("gate"), (recall * gate).alias("f1_gated"),
    )


def rescored(payloads: DataFrame, forced_model: str | None = None, **model_options) -> DataFrame:
    """(path, gene_a, gene_b, model, strategy, metrics...) of every answer in payloads (path, content): all but the prompt and blank ones are scored again; the baseline of naive payloads is called naive.

    What does not parse, or does not tell its pair by its name, gives no rows.
    """
    c = F.col("content")
    get = lambda p: F.get_json_object(c, p)
    told = payloads.select("path", evaluation.pair_of(F.col("path")).alias("p"), F.lit(forced_model).alias("_forced"), evaluation.model_of(F.col("path")).alias("_model"), evaluation.is_naive(F.col("path")).alias("_naive"), F.from_json(get("$.texts"), "map<string,string>").alias("texts"), F.from_json(get("$.ground_truth.features"), "array<string>").alias("features"), get("$.ground_truth.explanation").alias("explanation"))
    answers = told.filter("p IS NOT NULL").select("*", F.element_at("texts", "prompt").alias("context"), F.explode("texts").alias("strategy", "text")).filter((F.col("strategy") != "prompt") & (F.trim("text") != ""))
    rows = answers.withColumn("id", F.struct("path", "strategy"))
    metrics = text_metrics(rows.select("id", "text", "context", "features", "explanation"), **model_options)
    named = rows.select("id", F.col("p.a").alias("gene_a"), F.col("p.b").alias("gene_b"), F.coalesce("_forced", "_model").alias("model"), "_naive", "strategy")
    both = named.join(metrics, "id")
    return both.select(F.col("id.path").alias("path"), "gene_a", "gene_b", "model", F.when(F.col("_naive") & (F.col("strategy") == "baseline"), "naive").otherwise(F.col("strategy")).alias("strategy"), *(c for c in metrics.columns if c != "id"))
