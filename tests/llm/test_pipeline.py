"""The pipeline's stages, its last rows, and the registered queries without SQL against brute force on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import quality, queries, sketches
from tests.llm.test_operators import PATH, components, filled, shingles


@pytest.fixture(scope="module")
def table(small):
    read = lambda name: pq.read_table(f"{small}/{name}.parquet").to_pylist()
    return read("documents"), read("labels")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def tails(docs, labels, scored):
    """The classifier's probability of the best grade for scored texts, fitted in this process to the rated rows of docs."""
    grades = {r["doc_id"]: 0 if r["quality"] == 0 else 1 if r["toxic"] == 1 else 2 for r in labels if r["quality"] is not None and r["toxic"] is not None}
    rated = [r for r in docs if r["doc_id"] in grades]
    made = quality.features([(r["text"] or "").encode() for r in rated])
    rows = sorted(((hash_of(r["doc_id"]), grades[r["doc_id"]], len(x), i) for i, (r, x) in enumerate(zip(rated, made, strict=True)) if len(x)))
    model = quality.fit_arrays([made[i] for *_, i in rows], np.array([g for _, g, *_ in rows]))
    made = quality.features([(r["text"] or "").encode() for r in scored])
    return [float(t) if len(x) else 0.0 for x, t in zip(made, model.tails(quality.score_arrays(model, made))[:, -1], strict=True)]


_hashes = {}


def hash_of(doc_id):
    return _hashes[doc_id]


@pytest.fixture(scope="module", autouse=True)
def hashes(spark, table):
    """Spark's own hash of each id, which orders the sample."""
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(r["doc_id"],) for r in table[0]], "d long").select("d", F.xxhash64("d", F.lit("rated")).alias("h"))
    _hashes.update((r["d"], r["h"]) for r in ids.collect())


def mixed_times(docs, weight):
    """How often the mix takes each row, by sorting and summing whole sources."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    want, times = filled(sizes), {}
    for s in sizes:
        budget = round(want[s])
        epochs = budget // sizes[s] if sizes[s] else 0
        rest = budget - epochs * sizes[s]
        draw = lambda i: (int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        for _, i, n in sorted((-math.log(draw(r["doc_id"])) / max(0.01, weight[r["doc_id"]]), r["doc_id"], words(r["text"])) for r in docs if r["source"] == s):
            part = max(0, min(n, rest))
            rest -= n
            if n:
                times[i] = epochs + (part > 0 and 2 * part >= n)
    return {i: t for i, t in times.items() if t}


def test_stages_and_run(spark, small, table, library):
    docs, labels = table
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{small}/documents.parquet")
    kept = [r for r, t in zip(docs, tails(docs, labels, docs), strict=True) if t >= 0.5]
    out = stages["quality_classifier"](spark, frame, small)
    assert out.columns == frame.columns and sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(repr(tuple(r.values())) for r in kept)
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept}
    roots = components(sets)
    one = [r for r in kept if roots[r["doc_id"]] == r["doc_id"]]
    out = stages["minhash_near_dedup"](spark, spark.createDataFrame([tuple(r.values()) for r in kept], frame.schema), small)
    assert out.columns == frame.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in one) and len(one) < len(kept)
    weight = dict(zip((r["doc_id"] for r in one), tails(docs, labels, one), strict=True))
    times = mixed_times(one, weight)
    out = stages["source_mixing"](spark, spark.createDataFrame([tuple(r.values()) for r in one], frame.schema), small)
    assert out.columns == frame.columns and Counter(r["doc_id"] for r in out.collect()) == times
    text = {r["doc_id"]: r["text"] for r in one}
    last = corpus_pipeline.run(spark, small).collect()
    assert Counter(r["doc_id"] for r in last) == times
    for r in last:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_near_duplicate_stage_decides_by_row(spark, small):
    """Repeated rows, ids with several texts, null ids and texts, clashing columns."""
    long = " ".join(f"word{i}" for i in range(30))
    rows = [(1, long, "k1", 5), (2, long, "k2", 6), (3, long + " more", "k3", 7), (3, "something else that stands alone here", "k4", 8), (4, "x y", "k5", 9), (4, "x y", "k5", 9), (None, long, "k6", 1), (None, long, "k6", 1), (5, None, "k7", 2), (5, None, "k7", 2), (6, "", "k8", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, _row int")
    out = corpus_pipeline.without_near_duplicates(spark, df, small)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == df.columns
    assert got[(3, "something else that stands alone here")] == 1 and got[(4, "x y")] == 1 and got[(None, long)] == 2 and got[(5, None)] == 2 and got[(6, "")] == 1
    assert sum(got[k] for k in ((1, long), (2, long), (3, long + " more"))) == 1


def test_stages_on_odd_rows(spark, small):
    """Nulls in any column, long and empty texts, repeated rows and columns with the operators' own names pass through every stage."""
    good = "The quick brown fox jumps over the lazy dog and runs along the river bank again. "
    rows = [(1, good * 3, None, "s", 3, False), (1, good * 3, None, "s", 3, False), (2, None, "en", None, None, True), (None, "some words of no id " * 5, None, None, 1, None), (3, "", "", "", 0, True), (4, "w " * 60_000, "en", "t", 120_000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep boolean")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == df.columns, name
        assert {r["keep"] for r in docs.collect()} <= {False, True, None}
    assert all(r["keep"] is not True for r in docs.collect())  # the rows with True have no words; the column is the user's own


@pytest.mark.parametrize("name", ["op6_token_codec", "op7_bpe_trie", "op8_token_counts"])
def test_token_queries(spark, small, table, library, name):
    got = queries.QUERIES[name](spark, small).collect()
    start, want = 0, []
    for r in sorted(table[0], key=lambda r: r["doc_id"]):
        t = r["text"] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        if name == "op6_token_codec":
            whole = [*ids, 2]
            want.append((r["doc_id"], start, len(whole), zlib.crc32(np.array(whole, dtype="<u4").tobytes())))
            start += len(whole)
        elif name == "op7_bpe_trie":
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        else:
            want.append((r["doc_id"], len(t.encode()), len(ids), len(ids) > 512))
    assert sorted(map(tuple, got)) == want


def test_near_duplicate_query(spark, small, table):
    sets = {r["doc_id"]: shingles(r["text"]) for r in table[0]}
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.QUERIES["op9_near_duplicates"](spark, small).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_classifier_query(spark, small, table):
    docs, labels = table
    got = {r["doc_id"]: (r["tail_probability"], r["keep"]) for r in queries.QUERIES["op1_quality_classifier"](spark, small).collect()}
    want = dict(zip((r["doc_id"] for r in docs), tails(docs, labels, docs), strict=True))
    assert got.keys() == want.keys() and all(got[i][0] == pytest.approx(p, abs=1e-9) and got[i][1] == (p >= 0.5) for i, p in want.items())


def test_fingerprint_query(spark, small, table):
    docs = sorted(table[0], key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_fingerprints"](spark, small).collect()}
    by_text = {}
    for r, following in zip(docs, [*docs[1:], docs[0]], strict=True):
        t, n = r["text"] or "", following["text"] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        x = got[r["doc_id"]]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sketches.sketches([t, edited, n])
        assert (x["fingerprint"], x["edited_fingerprint"]) == (sketches.to_string(a), sketches.to_string(b))
        assert (x["near_edited"], x["near_next"]) == (sketches.resemblance(a, b), sketches.resemblance(a, c))
        assert by_text.setdefault(t, x["fingerprint"]) == x["fingerprint"]
        sets = [shingles(y) for y in (t, edited)]
        if all(sets):  # the estimate against the sets themselves
            assert x["near_edited"] == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), abs=0.17)
