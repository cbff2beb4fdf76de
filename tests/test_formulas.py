"""Hand-computed values of the scoring formulas."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("kind", "attrs", "expected"),
    [
        ("STRING_association", {"score": 0.95}, 0.684), ("DepMap_codependency", {"corr": -0.30}, 0.216), ("targets", {"phase": 2}, 0.36),
        ("TF_regulates", {"level": "B"}, 0.648), ("TF_regulates", {}, 0.504), ("driver_in", {"score": "0.05"}, 0.576), ("driver_in", {"score": "n/a"}, 0.72),
        ("mutated_in", {"mutations": 1}, 0.432), ("in_pathway", {"fdr": 0.10}, 0.432),
    ],
)
def test_evidence(spark, kind, attrs, expected):
    given = {k: F.lit(attrs.get(k)) for k in ("score", "corr", "phase", "level", "mutations", "fdr")}
    got = value(spark, scalars.evidence_score(F.lit(0.9), F.lit(0.8), F.lit(kind), **given))
    assert got == pytest.approx(expected)


def test_evidence_without_weights(spark):
    given = {k: F.lit(None) for k in ("score", "corr", "phase", "level", "mutations", "fdr")}
    assert value(spark, scalars.evidence_score(F.lit(None), F.lit(0.8), F.lit("x"), **given)) == 0.0


@pytest.mark.parametrize(("n", "s", "p", "r", "expected"), [(1, 0, 0.25, 0.1, 0.899966), (2, 0, 0.1, 0.05, 0.771667), (2, 1, 0.1, 0.05, 0.421667), (3, 2, 0.01, 0.001, 0.283433)])
def test_path_score(spark, n, s, p, r, expected):
    assert value(spark, scalars.path_rank_score(F.lit(n), F.lit(s), F.lit(p), F.lit(r), 3)) == pytest.approx(expected, abs=1e-6)


def test_linear_rank(spark):
    f = {"hop": F.lit(0.5), "evidence": F.lit(0.6), "prob": F.lit(0.05), "ppr": F.lit(0.01), "semantic": F.lit(0.3)}
    assert value(spark, scalars.linear_rank_score(f, scalars.NEIGHBOR_WEIGHTS)) == pytest.approx(0.4305)
    assert value(spark, scalars.linear_rank_score(f, scalars.NEIGHBOR_WEIGHTS, {"hop": True, "evidence": True, "semantic": True})) == pytest.approx(0.5)
    assert value(spark, scalars.linear_rank_score(f, {})) == 0.0


@pytest.mark.parametrize(("x", "expected"), [(-1, 0), (0, 0.5), (0.35, 0.613818), (0.6, 0.704833), (1, 1)])
def test_angular(spark, x, expected):
    assert value(spark, scalars.angular(F.lit(float(x)))) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(
    ("cosine", "feature", "phrase", "expected"),
    [(0.8, ["a", "b"], ["a"], 0.66), (0.8, ["a", "b"], ["c", "d"], 0.56), (0.65, ["a", "b"], ["c", "d", "e"], 0.325), (0.5, ["a"], ["c"], 0.175), (0.98, ["a"], ["a"], 0.9), (0.9, [], ["a"], 0.0)],
)
def test_adjusted(spark, cosine, feature, phrase, expected):
    arr = lambda x: F.array(*map(F.lit, x)) if x else F.expr("cast(array() as array<string>)")
    assert value(spark, scalars.adjusted_similarity(F.lit(cosine), arr(feature), arr(phrase))) == pytest.approx(expected)


def test_small_ones(spark):
    assert value(spark, scalars.grounded_score(F.lit(0.6), F.lit(0.7), F.lit(0.5))) == pytest.approx(0.35)
    assert value(spark, scalars.lexical_similarity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(0.733333, abs=1e-6)
    assert value(spark, scalars.clamp01(F.lit(math.nan))) == 0.0
    assert value(spark, scalars.hash_text(F.lit("abc"))) == "ba7816bf8f01cfea"
    assert value(spark, scalars.pair_key(F.lit(" snrpd3"), F.lit("KRAS"))) == "KRAS/SNRPD3"
    assert value(spark, scalars.clean_symbol(F.lit(" TP53 "))) == "TP53" and value(spark, scalars.clean_symbol(F.lit("-x"))) is None
    assert [value(spark, scalars.level_rank(F.lit(x))) for x in ("A", "e2", "", "F", None)] == [0, 4, 9, 9, 9]
    assert value(spark, scalars.is_accession(F.lit("P01106"))) and not value(spark, scalars.is_accession(F.lit("SLC2A1")))
    assert value(spark, scalars.tumor_code(F.lit("TCGA-BRCA"), ["BRCA"])) == "BRCA" and value(spark, scalars.tumor_code(F.lit("LUAD-US"), ["LUAD"])) == "LUAD"


SAMPLE = "Dr. KRAS loss slows growth [1, 2]. It is bad (gene:A -> gene:B | STRING_association | STRING | key=3)! See PMID: 123 and https://x.y/z for R-HSA-123 details. References: none"


def test_text(spark):
    t = F.lit(SAMPLE)
    assert value(spark, text.strip_citations(t)) == "Dr. KRAS loss slows growth  . It is bad  ! See   and   for   details. "
    assert value(spark, text.sentences(t, 1)) == ["Dr.", "KRAS loss slows growth  .", "It is bad  !", "See   and   for   details."]
    assert value(spark, text.sentences(t)) == ["KRAS loss slows growth  .", "See   and   for   details."]
    assert value(spark, text.citation_count(t)) == 1 and value(spark, text.citation_keys(t)) == 1
    assert value(spark, text.split_features(F.lit("a; b,c\n\nd"))) == ["a", "b", "c", "d"]
    assert value(spark, text.contains_feature(F.lit("the cell cycle"), F.lit("cell cycle"))) and not value(spark, text.contains_feature(F.lit("Cell cycle arrest"), F.lit("cell cycle")))
    assert not value(spark, text.contains_feature(F.lit(None).cast("string"), F.lit("x")))
    s = "1) x\n2) Mechanistic Summary: one\n- a\n* b\nOne:\nTwo:\n" + "y" * 340
    assert value(spark, text.structural_score(F.lit("1) a\n- b\n" + "x" * 391))) == pytest.approx(0.65)
    assert value(spark, text.primary_text(F.lit(s))).startswith("one\n- a")
    assert value(spark, text.primary_text(F.lit("a\n3) Evidence Chains\nb\n4) c\nD"))) == "a\n4) c\nD"
    assert value(spark, text.explicit_phrases(F.lit("x\nKey process phrases: cell cycle (fast); ab; dna repair.\n"))) == ["cell cycle", "dna repair"]
    assert value(spark, text.filter_candidates(F.array(*map(F.lit, ["KRAS", "the", "(dna repair)", "DNA repair", "growth of cells", "12"])), F.array(F.lit("growth")))) == ["growth of cells", "dna repair"]
    assert value(spark, text.json_object(F.lit("x {bad} {\"a\": 1} y"))) == '{"a": 1}' and value(spark, text.json_object(F.lit("none"))) is None
    assert value(spark, text.dedupe_keep_order(F.array(F.lit("a  b"), F.lit("A b"), F.lit(" "), F.lit("c")))) == ["a b", "c"]
    assert value(spark, text.kg_sentences(F.lit("KRAS -> TP53 | acts_on | x\nnode one: a long description of it\nEdges: nothing to see here at all"))) == ["KRAS acts on TP53", "a long description of it"]


@pytest.mark.parametrize(("n", "lengths"), [(0, []), (1200, [1200]), (1201, [1200, 301]), (1800, [1200, 900]), (1801, [1200, 901, 1]), (3000, [1200, 1200, 1200, 300])])
def test_chunks(spark, n, lengths):
    assert [len(x) for x in value(spark, text.chunks(F.lit("x" * n)))] == lengths
