"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import io
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe_trie, common, compaction, mixing, near_dedup, quality, sketches, token_cache, token_codec, topk, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Columns whose names operators use themselves.
CLASH = "key int, node int, size int, target int, component int, digest int, _id int, _text int, keep int, grade int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 60))) for _ in range(n)]


def odd_texts():
    return [None, "", " \n\t ", "one", "É straße 漢字 🎉 <|endoftext|> 'll don't", "a" * 5000, "\x1c\x85\xa0 x", "word " * 30_000, "same text here", "same text here"]


def docs_of(spark, rows):
    """(doc_id, source, text) and clashing columns."""
    data = [(i, s, t, *range(10)) for i, s, t in rows]
    return spark.createDataFrame(data, "doc_id long, source string, text string, " + CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "s", t) for i, t in enumerate(odd_texts())] + [(8, "s", "same text here"), (None, None, "no id")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# -- shingles ---------------------------------------------------------------------------------------------------------------------


def shingles(text, k=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_shingle_sizes():
    given = [t or "" for t in odd_texts()] + texts(1, 50)
    assert [len(s) for s in common.shingle_sets(map(common.as_bytes, given))] == [len(shingles(t)) for t in given]


# -- 1 ----------------------------------------------------------------------------------------------------------------------------


def rated(n, seed=5):
    r, out = random.Random(seed), []
    for _ in range(n):
        g = r.choice([0, 1, 2, 2])
        w = [r.choice(WORDS) for _ in range(r.randrange(30, 80))]
        if g == 0:
            w = [x.upper() + "!!" for x in w]
        if g == 1:
            w[r.randrange(len(w))] = w[r.randrange(len(w))] = "scoundrel"
        out.append((" ".join(w), g))
    return out


def test_quality_held_out():
    rows = rated(900)
    x, y = quality.features([t.encode() for t, _ in rows]), np.array([g for _, g in rows])
    m = quality.fit_arrays(x[:600], y[:600])
    assert list(m.thresholds) == sorted(m.thresholds)
    tails = m.tails(quality.score_arrays(m, x[600:]))
    assert np.all(tails[:, 0] >= tails[:, 1])
    assert ((tails >= 0.5).sum(axis=1) == y[600:]).mean() > 0.95


def test_quality_slopes_against_differences():
    """The derivatives that the fit follows, against differences of the log-likelihood written out from its definition."""
    r = np.random.default_rng(3)
    grades, score, b, weight = r.integers(0, 4, 60), r.normal(0, 2, 60), np.array([-1.2, 0.1, 1.9]), r.uniform(0.5, 2, 60)

    def loss(s, t):
        total = 0.0
        for x, g, w in zip(s, grades, weight, strict=True):
            at_least = [1.0, *(1 / (1 + np.exp(-(x - e))) for e in t), 0.0]
            total -= w * np.log(at_least[g] - at_least[g + 1])
        return total

    by_score, by_threshold = quality.slopes(score, b, grades, weight)
    for i in range(0, 60, 7):
        step = np.zeros(60)
        step[i] = 1e-6
        assert by_score[i] == pytest.approx((loss(score + step, b) - loss(score - step, b)) / 2e-6, rel=1e-4, abs=1e-6)
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        assert by_threshold[k] == pytest.approx((loss(score, b + step) - loss(score, b - step)) / 2e-6, rel=1e-4, abs=1e-6)


def test_quality_fit_against_descent():
    """A fit of one feature against plain descent on the same likelihood, without the pull to zero: probabilities agree."""
    r = np.random.default_rng(5)
    has = r.random(1500) < 0.5
    grades = np.where(has, r.choice(3, 1500, p=[0.1, 0.3, 0.6]), r.choice(3, 1500, p=[0.6, 0.3, 0.1]))
    model = quality.fit_arrays([np.array([3, 9] if h else [9], dtype=np.int32) for h in has], grades)
    often = np.bincount(grades)
    weight = np.sqrt(1500 / often / 3)[grades]
    w, b = np.zeros(2), np.array([-0.5, 0.5])
    for _ in range(4000):
        by_score, by_threshold = quality.slopes(w[0] * has + w[1], b, grades, weight)
        w, b = w - 0.5 / 1500 * np.array([by_score[has].sum(), by_score.sum()]), b - 0.5 / 1500 * by_threshold
    got = model.tails(quality.score_arrays(model, [np.array([9], dtype=np.int32), np.array([3, 9], dtype=np.int32)]))
    want = quality.Model(np.zeros(1), b).tails(np.array([w[1], w[0] + w[1]]))
    assert np.abs(got - want).max() < 0.06


def test_quality_bounds_and_clashes(spark):
    """The bound on features, ids that come with several texts, and columns with the scores' names."""
    rows = [(i, "s", f"good words here number{i} " * 3 if i % 2 else f"### $$$ {i} %%% " * 3) for i in range(60)]
    df = docs_of(spark, rows + [(1, "s", "good words again")] * 30)
    ratings = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int")
    assert quality.fit(df, ratings, most=1) is None  # a single rating teaches nothing
    model = quality.fit(df, ratings)
    out = quality.scored(df, model, names=("_g", "_p", "_k"))
    assert out.columns == [*df.columns, "_g", "_p", "_k"] and out.select("keep").distinct().count() == 1 and out.filter("_k").count() > 0


def test_quality_cases(spark, odd, empty):
    ratings = spark.createDataFrame([(3, 2), (4, 0), (5, 2), (5, None), (None, 1), (6, 1), (6, 2)], "doc_id long, grade int")
    model = quality.fit(odd, ratings)
    out = quality.scored(odd, model)
    assert out.count() == odd.count() and {"expected_grade", "tail_probability", "keep"} <= set(out.columns)
    blank = out.filter("text IS NULL OR trim(translate(text, '\n\t', '')) = ''").collect()
    assert blank and all(not r["keep"] and r["expected_grade"] == 0 for r in blank)
    assert quality.fit(odd, ratings.filter("grade = 2")) is None and quality.fit(empty, ratings) is None
    unlearnt = quality.scored(odd, None).collect()
    assert all(r["keep"] == bool((r["text"] or "").strip()) for r in unlearnt)
    assert quality.scored(empty, model).count() == 0


# -- 2 ----------------------------------------------------------------------------------------------------------------------------


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    r = np.random.default_rng(2)
    v = [(i, [float(x) for x in r.normal(0, 0.1, 6)], 0) for i in range(200)]
    v += [(i, [0.5] * 6, 0) for i in range(200, 240)] + [(240, None, 0), (241, [0.1, None], 0), (242, [float("nan")], 0), (243, [float("inf")], 0), (None, [0.1] * 6, 0), (20, [0.9] * 6, 1), (244, [], 0), (245, [0.3], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, score int")
    got = {}
    for x in topk.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    whole = [(i, np.pad(np.floor(64 * np.array(e, dtype=np.float32).astype(float)), (0, 6 - len(e)))) for i, e, _ in v if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    asked = {}
    for i, q in whole:
        if i % 20 == 0 and (i not in asked or tuple(q) < tuple(asked[i])):
            asked[i] = q
    for i, q in asked.items():
        best = sorted(((-int(q @ c), j) for j, c in whole if j != i))[:20]
        assert sorted(got[i], key=lambda x: (-x[1], x[0])) == [(j, -s) for s, j in best]
    assert set(got) == set(asked)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def ranked(ids, v, i, k=20):
    whole = [int(sum(int(x) * int(y) for x, y in zip(c, v[i], strict=True))) for c in v]
    return sorted((-s, int(j)) for s, j in zip(whole, ids, strict=True) if j != ids[i])[:k]


def test_topk_lists_stop():
    """Where components have contrast the lists show, and the search touches, a small share of all pairs; where they have none every candidate is scored once and no more."""
    import pyarrow.parquet as pq

    r = np.random.default_rng(8)
    steep = (r.pareto(1.2, size=(3000, 8)) * np.sign(r.normal(size=(3000, 8)))).astype(np.int64).astype(np.float64)
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet", columns=["vec_id", "embedding"])
    t = t.filter(t["embedding"].is_valid())
    flat = np.floor(64 * np.stack([np.array(x, dtype=np.float64) for x in t["embedding"].to_pylist()])).astype(np.float32)
    for ids, v, most in ((np.arange(3000), steep, 0.2), (t["vec_id"].to_numpy(), flat, 1.0)):
        lists, asked = topk.Lists(ids, v), np.flatnonzero(ids % 20 == 0)
        touched = 0
        for i, (found, score, n) in zip(asked, lists.top(ids[asked].tolist(), v[asked], 20), strict=True):
            assert [(-int(s), int(j)) for s, j in zip(score, found, strict=True)] == ranked(ids, v, i)
            touched += n
        assert touched <= most * len(asked) * len(ids)


@pytest.mark.parametrize("scale", [1, 1 << 14, 1 << 27, 1 << 33])
def test_topk_large_components(spark, scale):
    """Scores are whole numbers, whatever the size of the components; one that no long holds is an error."""
    r = np.random.default_rng(4)
    v = [[int(x) * scale + int(y) for x, y in zip(r.integers(-1, 2, 5), r.integers(-3, 4, 5), strict=True)] for _ in range(120)]
    df = spark.createDataFrame([(i, [x / 64 for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    found = topk.search(df, F.col("vec_id") % 20 == 0, 20)
    if scale == 1 << 33:
        with pytest.raises(Exception, match="beyond a long"):
            found.collect()
        v = [[x if i == 0 else x % 7 for x in e] for i, e in enumerate(v)]
        v[0][0] = 1 << 61
        v = [[0 if i and j == 0 else x for j, x in enumerate(e)] for i, e in enumerate(v)]
        df = spark.createDataFrame([(i, [x / 64 for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
        found = topk.search(df, F.col("vec_id") % 20 == 0, 20)
    got = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    assert got == {i: ranked(np.arange(120), v, i) for i in range(0, 120, 20)}


# -- 3 ----------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<html>" + "x" * 200_000
    pages = [(1, "http://a/b c\r\nX: y", big), (2, None, big), (3, "u", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (0, "u", "é" * 60), (7, "u", "é" * 60), (7, "u", "é" * 60), (None, "u", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_digest int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df, common.scratch(spark, "t")).collect()), key=repr)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = min(j for j, _, x in pages if j is not None and (x or "").encode() == b)
        again = len(b) >= 100 and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0), common.scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("hot", [1, 1000])
def test_warc_long_urls_and_odd_ids(spark, monkeypatch, hot):
    """Whatever a row holds, it comes back: URLs beyond any buffer, ids that are negative or missing; popular payloads by either join."""
    monkeypatch.setattr(warc, "HOT", hot)
    pages = [(-1, "http://a/" + "u" * (1 << 20), "x" * 200), (None, "http://b/" + "v" * 70_000, "x" * 200), (3, "w", "x" * 200), (4, "", "y" * 100), (5, "z", "y" * 100), (None, None, "n" * 300), (None, None, "n" * 300), (-9, "", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df, common.scratch(spark, "t")).collect()), key=repr)
    want = [(-1, 200, "response", None), (None, 200, "revisit", -1), (3, 200, "revisit", -1), (4, 100, "response", None), (5, 100, "revisit", 4), (None, 300, "response", None), (None, 300, "response", None), (-9, 0, "response", None)]
    assert got == sorted(want, key=repr)


def test_warc_foreign_header_bound():
    one = warc.record(1, "u" * 5000, b"abc", None, hashlib.sha256(b"abc").hexdigest())
    assert warc.parse(one)[1].endswith(b"abc")
    with pytest.raises(warc.WarcError):
        warc.parse(one, most=1000)


def archive(n=30):
    body = [f"<p>{i}</p>".encode() * 50 for i in range(n)]
    out = io.BytesIO()
    warc.write_archive(out, [warc.record(i, "u", b, None, hashlib.sha256(b).hexdigest()) for i, b in enumerate(body)], body)
    return out.getvalue()


def test_warc_faults():
    good = archive()
    assert len(list(warc.read_pages(io.BytesIO(good)))) == 30 and list(warc.read_pages(io.BytesIO(b""))) == []
    assert good[:4] == b"\x5d\x2a\x4d\x18"
    flipped = bytearray(good)
    flipped[-20] ^= 1
    for bad in (good[:-3], good[:40], b"XXXX" + good, bytes(flipped), good + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_pages(io.BytesIO(bad)))
    one = warc.record(1, "u", b"abc", None, hashlib.sha256(b"abc").hexdigest())
    warc.parse(one)
    for bad in (one.replace(b"WARC/1.1", b"WARC/9"), one.replace(b"WARC-Type: response\r\n", b""), one.replace(b"response\r\nWARC-Record", b"odd\r\nWARC-Record"), one[:-1], one + b"x", one.replace(b"abc", b"abd"), one.replace(b"WARC-Date: ", b"WARC-Date"), b"no end"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


# -- 4 ----------------------------------------------------------------------------------------------------------------------------


def filled(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w, total, full = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        rest, weight = total - sum(full.values()), sum(w[s] for s in free)
        t = {s: rest * w[s] / weight for s in free} | full
        over = [s for s in free if t[s] > 2 * sizes[s]]
        if not over:
            return t
        full |= {s: 2 * sizes[s] for s in over}


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "a", "b", "ç", "Z", None]), t) for i, t in enumerate(texts(9, 300))] + [(300, "none", None), (301, "none", " "), (302, "big", "w " * 20_000), (5, "a", "again"), (None, "a", "no id")]
    df = docs_of(spark, rows)
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(df).collect()), key=repr)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    by = {}
    for x in mixing.plan(df, keep=("source",)).collect():
        assert 0 <= x["taken"] <= 2 * x["size"] and x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
        by[x["source"]] = by.get(x["source"], 0) + x["taken"]
    assert all(abs(by[s] - want[s]) <= 1 for s in sizes)
    mix = mixing.mix(df)
    assert mix.columns == df.columns and mix.filter("text IS NULL").count() == 0
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mixed(docs_of(spark, [(1, "a", None)])).first()["taken"] == 0


@pytest.mark.parametrize("weight", [0.05, 0.5, 1.0])
def test_edge_bucket_is_small(spark, monkeypatch, weight):
    """Whatever the quality weight makes of the keys, few rows are sorted, and the source's budget is met exactly; rows that repeat an id are one."""
    monkeypatch.setattr(mixing, "SPLIT", 16)
    monkeypatch.setattr(mixing, "BUCKET", 100)
    sizes, real = [], common.saved
    monkeypatch.setattr(mixing.common, "saved", lambda df, name: (lambda d: (sizes.append(d.count()) if name == "mix-close" else None, d)[1])(real(df, name)))
    df = docs_of(spark, [(i, "only", "w " * (1 + i % 7)) for i in range(20_000)] + [(None, "only", "null " * 3)] * 500)
    total = df.select(F.sum(mixing.words(F.col("text")))).first()[0]
    out = mixing.plan(df, quality_col=F.lit(weight), share=0.6).agg(F.sum("taken"), F.max("target")).first()
    assert abs(out[0] - round(0.6 * total)) <= 500 and out[1] == pytest.approx(0.6 * total)
    assert sizes[-1] <= 4 * mixing.BUCKET or sizes[-1] <= 500 + mixing.BUCKET


def test_quality_weights_count(spark):
    df = docs_of(spark, [(i, f"s{i % 4}", "w " * 10) for i in range(4000)])
    t = mixing.plan(df, quality_col=F.when(F.col("doc_id") % 8 < 4, 4.0).otherwise(1.0), weights=(1, 1, 1, 1), share=0.5).select((F.col("doc_id") % 8 < 4).alias("good"), "taken").groupBy("good").agg(F.sum("taken").alias("n")).collect()
    n = {r["good"]: r["n"] for r in t}
    assert n[True] > 2 * n[False]


# -- 5 ----------------------------------------------------------------------------------------------------------------------------


def test_compaction(spark, odd):
    t = compaction.ShardedTable(spark, common.scratch(spark, "t"), odd.schema, target_bytes=60_000, fanout=3, least_bytes=1000)
    assert t.read().count() == 0 and t.versions() == []
    for _ in range(7):
        t.append(odd.repartition(3))
        t.compact()
    t.append(odd.limit(0))
    before = t.manifest()
    t.compact(final=True)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(t.read()) == sorted(rows(odd) * 7)
    shards = t.manifest()["shards"]
    assert sum(s["rows"] for s in shards) == 7 * odd.count() and len(shards) < 21
    assert all(s["bytes"] <= 2 * t.target for s in shards)
    with pytest.raises(compaction.Conflict):
        t.commit(t.manifest()["version"] - 1, before["shards"])
    assert t.manifest()["shards"] == shards


def test_compaction_keeps_readers(spark, odd):
    """A lazy read of an older version outlives compactions; beyond the retention old versions, their files and those of failed writers go, and the rows stay."""
    t = compaction.ShardedTable(spark, common.scratch(spark, "t"), odd.schema, target_bytes=60_000, fanout=2, least_bytes=1000)
    for _ in range(4):
        t.append(odd.repartition(2))
    early, before = t.read(), t.versions()[-1]
    t._write(odd, "merge")  # a writer that fails before its commit
    t.compact(final=True)
    assert early.count() == 4 * odd.count() == t.read().count() and t.versions()[0] == 1
    files = lambda: {f for s in t._listed("data") for f in (x.getPath().getName() for x in t._listed(f"data/{s.getPath().getName()}")) if f.startswith("part-")}
    many = len(files())
    t.vacuum(keep=2, seconds=-10, orphans=-10)
    assert len(t.versions()) == 2 and len(files()) < many and t.read().count() == 4 * odd.count() and t.read(t.versions()[0]).count() == 4 * odd.count()
    t.vacuum(keep=1, seconds=-10, orphans=-10)
    assert len(files()) == len(t.manifest()["shards"]) and before not in t.versions()
    t.append(odd)
    assert t.read().count() == 5 * odd.count()


def test_compaction_writers_meet(spark, odd, monkeypatch):
    """Two writers: an append during a merge, and two merges of the same shards."""
    make = lambda: compaction.ShardedTable(spark, path, odd.schema, target_bytes=60_000, fanout=2, least_bytes=1000)
    path = common.scratch(spark, "t")
    one, other = make(), make()
    for _ in range(4):
        one.append(odd.repartition(2))
    real, calls = one._merge, []

    def meanwhile(runs):
        made = real(runs)
        if not calls:
            calls.append(1)
            other.append(odd.limit(3))
        elif len(calls) == 1:
            calls.append(1)
            other.compact(final=True)
        return made

    monkeypatch.setattr(one, "_merge", meanwhile)
    one.append(odd)
    one.compact(final=True)
    one.append(odd)
    one.compact(final=True)
    assert one.read().count() == 6 * odd.count() + 3 == other.read().count()


def test_compaction_plan(spark):
    t = compaction.ShardedTable(spark, common.scratch(spark, "t"), spark.range(0).schema, target_bytes=1000, fanout=4, least_bytes=10)
    shard = lambda i, n: {"path": str(i), "bytes": n, "rows": 1}
    assert t.plan([shard(i, 20) for i in range(3)]) == [] and t.plan([shard(i, 900) for i in range(9)]) == []
    runs = t.plan([shard(i, 20) for i in range(9)] + [shard(9 + i, 300) for i in range(5)])
    assert sorted(len(r) for r in runs) == [2, 3, 9] and all(sum(s["bytes"] for s in r) <= 1000 for r in runs)


def test_arrivals_cover(spark):
    df = docs_of(spark, [(i if i % 7 else None, "s", "t") for i in range(100)])
    assert sum(p.count() for p in compaction.arrivals(df, "doc_id", 4)) == 100 and sum(p.count() for p in compaction.arrivals(df.limit(0), "doc_id", 4)) == 0


# -- 6 ----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0], [65535, 0] * 40, [7] * 500, list(range(0, 65536, 7))])
def test_codec_round_trip(ids, monkeypatch):
    monkeypatch.setattr(token_codec, "BLOCK", 1000)
    a = np.array(ids, dtype="<u2")
    out = io.BytesIO()
    token_codec.write_file(out, [4, None], [len(a), 0], a)
    doc_ids, lengths, back = token_codec.read_file(io.BytesIO(out.getvalue()))
    assert doc_ids == [4, None] and list(lengths) == [len(a), 0] and np.array_equal(back, a)


def test_codec_blocks_are_independent_and_checked():
    r = np.random.default_rng(1)
    blocks = [r.integers(0, 300, n).astype("<u2") for n in (500, 1, 77)]
    packed = token_codec.encode_blocks(blocks)
    assert packed == [token_codec.encode_blocks([b])[0] for b in blocks]
    assert len(packed[0]) < 2 * len(blocks[0])
    out = io.BytesIO()
    token_codec.write_file(out, [1], [500], blocks[0])
    good = out.getvalue()
    bad = bytearray(good)
    bad[-100] ^= 4
    for data in (bytes(bad), good[:-5], b"XXXX" + good[4:]):
        with pytest.raises(token_codec.FormatError):
            token_codec.read_file(io.BytesIO(data))


def test_codec_size_and_windows():
    """Many windows, several blocks, pairs that repeat: smaller than deflated ids, and every id comes back."""
    r = np.random.default_rng(4)
    follow = r.integers(0, 3000, (3000, 4))
    ids = [0]
    for _ in range(150_000):
        ids.append(int(follow[ids[-1], min(3, r.geometric(0.5) - 1)]) if r.random() < 0.8 else int(r.integers(0, 3000)))
    a = np.array(ids, dtype="<u2")
    blocks = [a[at : at + token_codec.BLOCK] for at in range(0, len(a), token_codec.BLOCK)]
    packed = token_codec.encode_blocks(blocks)
    for x, y in zip(blocks, token_codec.decode_blocks(packed, [len(b) for b in blocks]), strict=True):
        assert np.array_equal(x, y)
    assert sum(map(len, packed)) < 0.9 * len(zlib.compress(a.tobytes(), 6))


def test_library_words_fuzzed(library, monkeypatch):
    """Pieces cut at spaces give the library's ids, whatever white space, contractions and special strings stand around them, and when words are forgotten."""
    monkeypatch.setattr(token_codec, "KEPT_WORDS", 40)
    monkeypatch.setattr(token_codec, "KEPT_LENGTH", 6)
    r = random.Random(7)
    letters = [*"ab1 '  \n\t\r,.!", "\xa0", "é", "\u3000", "\x1c", "\x85", "漢", "🎉", "'s", " 'll", "<|endoftext|>", "longerword", "  "]
    words = token_codec.LibraryWords(PATH)
    for _ in range(40):
        some = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(50)]
        assert [np.frombuffer(b, "<u2").tolist() for b in words.encode_batch(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_codec_documents(spark, library, odd, empty):
    folder = common.scratch(spark, "t")
    got = token_codec.read_tokens(token_codec.write_tokens(odd, folder, PATH), folder).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = common.scratch(spark, "t")
    assert token_codec.read_tokens(token_codec.write_tokens(empty, folder, PATH), folder).count() == 0


# -- 7 and 8 ----------------------------------------------------------------------------------------------------------------------


def test_trie_against_library(library):
    r = random.Random(7)
    letters = " \n\t\r\x0b\x1c\x85\xa0'sdtrvelmÁé漢ⅷ²٣0123.,;!😀⺰\U000323b0\U00010d40"
    given = [t or "" for t in odd_texts()] + ["".join(r.choice(letters) if r.random() < 0.95 else "<|endoftext|>" for _ in range(r.randrange(50))) for _ in range(3000)]
    bpe = bpe_trie.TrieBpe(PATH)
    for t, ids, e in zip(given, bpe.encode_batch(given), library.encode_batch(given, add_special_tokens=False), strict=True):
        assert ids == e.ids and bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_trie_forgets(library, monkeypatch):
    monkeypatch.setattr(bpe_trie, "KEPT_WORDS", 10)
    monkeypatch.setattr(bpe_trie, "KEPT_PAIRS", 10)
    bpe, given = bpe_trie.TrieBpe(PATH), texts(3, 40)
    assert list(bpe.encode_batch(given)) == [e.ids for e in library.encode_batch(given, add_special_tokens=False)]


def test_encoding_digests(spark, library, odd, empty):
    for r in bpe_trie.encoding_digests(odd, PATH, with_ids=True).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_trie.encoding_digests(odd, PATH).count() == odd.count() and bpe_trie.encoding_digests(empty, PATH).count() == 0


def test_token_cache(spark, library, odd, empty):
    cache = common.scratch(spark, "cache")
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 512) for r in odd.collect()), key=repr)
    for _ in range(2):
        assert sorted(map(tuple, token_cache.count_tokens(odd, PATH, cache).collect()), key=repr) == want
    stored = token_cache.read_cache(spark, cache)
    assert stored.count() == len({r["text"] or "" for r in odd.collect()})  # the second call has added nothing
    token_cache.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model"), cache).count()
    assert token_cache.read_cache(spark, cache).select("tokenizer_digest").distinct().count() == 2
    assert token_cache.count_tokens(empty, PATH, common.scratch(spark, "cache")).count() == 0


# -- 9 and 10 ---------------------------------------------------------------------------------------------------------------------


def components(sets, percent=85):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    r = random.Random(8)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(20, 120))) for _ in range(25)]
    given = [t or "" for t in odd_texts()]
    for b in base:
        for _ in range(r.randrange(1, 9)):
            w = b.split()
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = "changed"
            given.append(" ".join(w).upper() if r.random() < 0.2 else "\n".join(w))
    r.shuffle(given)
    rows = [(3 * i, "s", t) for i, t in enumerate(given)]
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(docs_of(spark, [*rows, (None, "s", given[0]), (None, "s", None)])).collect() if x["doc_id"] is not None}
    sets = {i: shingles(t) for i, _, t in rows}
    want = components(sets)
    assert {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_odd(spark, odd, empty):
    out = near_dedup.near_duplicates(odd)
    assert out.count() == odd.count() and out.filter("doc_id IS NULL AND kept AND component_id IS NULL").count() == 1
    assert near_dedup.near_duplicates(empty).count() == 0
    two = docs_of(spark, [(1, "s", "a b c d e f"), (2, "s", "g h i j k l"), (2, "s", "a b c d e f"), (3, "s", "g h i j k l")])
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(two).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_chained_texts_are_not_compared_across(spark):
    """Texts that chain through buckets far below the threshold: what is compared stays near the sum of the buckets' squares, far from the square of the chain."""
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(40 + 10 * 600)]
    chain = [" ".join(words[10 * i : 10 * i + 40]) for i in range(600)]  # neighbours share three quarters of their words, likeness about 0.57
    df = docs_of(spark, [(i, "s", t) for i, t in enumerate(chain)])
    described = near_dedup._described(df, "doc_id", "text", near_dedup.ROWS, near_dedup.BANDS)
    classes = described.select(F.col("_id").alias("node"), "keys")
    buckets = common.saved(near_dedup.candidate_buckets(classes), "t")
    near = buckets.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    from loomgraph.operators.components import connected_components

    assert connected_components(near).groupBy("component").count().agg(F.max("count")).first()[0] > 20  # they do chain
    alone = spark.createDataFrame([], "node long, component long")
    pairs = near_dedup.open_buckets(buckets, alone).groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    assert pairs + near.count() < 20 * 600
    got = near_dedup.near_duplicates(df)
    assert got.filter("NOT kept").count() == 0 and got.count() == 600


def test_unsettled_buckets(spark, monkeypatch):
    """Links between members that are not linked to their bucket's smallest one are found as well."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 2)
    r = random.Random(11)
    rows = []
    for g in range(12):
        base = [r.choice(WORDS) + str(r.randrange(60)) for _ in range(90)]
        for k in range(9):
            w = list(base)
            for _ in range(4 * (k % 3)):  # some versions are far from the first one and near to each other
                w[r.randrange(len(w))] = f"v{k}"
            rows.append((len(rows), "s", " ".join(w)))
    sets = {i: shingles(t) for i, _, t in rows}
    want = components(sets)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs_of(spark, rows), rows=2, bands=60).collect()}
    assert got == want


def test_signature_estimates():
    r = np.random.default_rng(5)
    a = np.unique(r.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:800], r.integers(0, 1 << 62, 200).astype(np.uint64))))
    s = near_dedup.signatures([a, b], 2400)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_fingerprints(spark, odd, empty, monkeypatch):
    for parts in (4096, 3):
        monkeypatch.setattr(sketches, "MOST_PARTS", parts)
        df = docs_of(spark, [(i * 2, "s", t) for i, t in enumerate([*odd_texts(), *texts(4, 60)])])
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), reverse=True)
        got = {r["doc_id"]: r for r in sketches.fingerprints(df).collect()}
        for at, (i, t) in enumerate(rows):
            following = rows[(at + 1) % len(rows)][1]
            half = len(t) // 2
            new = t[: len(t) - half] + following[:half]
            x = got[i]
            assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            for other, told in ((new, x["near_edited"]), (following, x["near_next"])):
                a, b = shingles(t), shingles(other)
                true = len(a & b) / len(a | b) if a | b else 1.0
                assert told == pytest.approx(true, abs=0.15 if len(a | b) > sketches.K else 1e-9)
        assert got[16]["fingerprint"] == got[18]["fingerprint"]
    assert sketches.fingerprints(odd).count() == odd.count() and sketches.fingerprints(empty).count() == 0
    one = sketches.fingerprints(docs_of(spark, [(1, "s", "abcd")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_fingerprints_of_hot_ids(spark, monkeypatch):
    """Ids that hold many rows, the smallest and no id among them, are cut, and every row still follows another: as many times as each text is edited into, it follows."""
    monkeypatch.setattr(sketches, "MOST_PARTS", 8)
    made = texts(14, 600)
    rows = [((i, 7, None)[i % 3], "s", t) for i, t in enumerate(made)]
    df = docs_of(spark, rows)
    parted, parts = sketches.with_following(df, "doc_id", "text")
    assert parts > 8 and parted.filter("_copy = 0").groupBy("_part").count().agg(F.max("count")).first()[0] < 120
    got = sketches.fingerprints(df).collect()
    want = {}
    for r in got:
        want.setdefault(r["doc_id"], []).append(r)
    order = sorted({r[0] for r in rows}, key=lambda i: (i is None, -(i or 0)))
    by_id = {i: [t for j, _, t in rows if j == i] for i in order}
    assert len(got) == 600 and all(len(want[i]) == len(by_id[i]) for i in order)
    edits = {}
    for i in order:
        after = order[(order.index(i) + 1) % len(order)]
        for r in want[i]:
            found = [(t, f) for t in by_id[i] for f in (*by_id[i], *by_id[after]) if len(t) == r["n_chars"] and (f is not t or len(order) == 1) and hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest() == r["edited_sha256"]]
            assert found, i
            edits[i] = edits.get(i, 0) + 1
    # A chain: of the rows of an id one alone goes on to the next id.
    for i in order:
        if len(by_id[i]) > 1:
            inner = {hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest() for t in by_id[i] for f in by_id[i] if f is not t}
            assert sum(r["edited_sha256"] not in inner for r in want[i]) <= 1


def test_sketches_merge():
    r = np.random.default_rng(6)
    a = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[::2], r.integers(0, 1 << 63, 2500).astype(np.uint64) * np.uint64(2))))
    sa, sb = sketches.sketch(a), sketches.sketch(b)
    assert np.array_equal(sketches.merge(sketches.sketch(a[::2]), sketches.sketch(a[1::2])), sa)
    assert sketches.distinct_count(sa) == pytest.approx(len(a), rel=0.2)
    assert sketches.containment(sa, sb) == pytest.approx(0.5, abs=0.12) and sketches.resemblance(sa, sb) == pytest.approx(1 / 3, abs=0.1)
    back, k = sketches.from_string(sketches.to_string(sa))
    assert k == sketches.K and np.array_equal(back, sa)
