"""Expressions that must be worked out once a row."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.functions import text
from loomgraph.operators import stats


def test_edges_of_a_context_are_matched_once(spark, small):
    """A lambda works out what it names from outside for every element, and a filter on a result works it out again."""
    plan = entry.queries()["kg_edge_sentences"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 3


def test_texts_are_cut_and_split_once(spark, small):
    """chunk_text works the trimmed text out once for all of its chunks, content_tokens the tokens once for its three counts."""
    plan = lambda name: entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    chunks = plan("chunk_text")
    assert chunks.count("coalesce(text") <= 1 and "regexp_replace" not in chunks
    assert plan("content_tokens").count("regexp_extract_all(") <= 1


def test_trimmed_is_what_the_pattern_trims(spark):
    """Every white space of Unicode at either end, and none within."""
    texts = [f"{chr(i)}a{chr(i)}b \n{chr(i)}" for i in range(0x3100) if not 0xD800 <= i < 0xE000] + ["", " ", "\r\n", "x\r\n", "  x\u0085\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(text.trimmed(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0


def test_content_is_neither_stop_word_nor_number(spark):
    """As the list and the pattern for numbers tell it, token by token."""
    got = spark.createDataFrame([("The GENE 12 a1 1a x 007 of Word's é9",), (None,)], "t string").select(text.content_tokens(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [["a1", "1a", "x", "word", "s"], []]


def test_effect_bars_rank_only_what_they_return(spark):
    """No window sees all deltas of the metric; the first and last of an odd number of bars, and all where there are no more."""
    rows = [(i, "m", float(i % 5)) for i in range(23)] + [(99, "other", 0.0)]
    pairs = spark.createDataFrame(rows, "item long, metric string, delta double")
    order = sorted((d, i) for i, m, d in rows if m == "m")
    for top, want in ((7, [0, 1, 2, 20, 21, 22]), (2, [0, 22]), (23, range(23)), (50, range(23))):
        df = stats.effect_bars(pairs, "m", top)
        assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["place"], r["delta"], r["item"]) for r in df.collect()) == [(k + 1, *order[k]) for k in want]
    assert stats.effect_bars(pairs, "none", 4).count() == 0
