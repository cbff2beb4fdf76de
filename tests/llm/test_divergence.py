"""The source audit against plain sums over every term and pair, whatever part of the split a term falls into, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loomgraph.llm import divergence

SCHEMA = "lang string, source string, text string, term int, at int, p int, kind int, doc_id long"


def plain(rows, least=10, top=10):
    low = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(low(text)))
        counts[lang, source].update(low(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        every = sum(total.values())
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (every + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, None) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, sources, n):
    """Common terms that every source has, and rare ones of a few sources."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if r.random() < 0.33 else f"s{r.randrange(sources)}"
        common = [f"c{chr(97 + min(25, int(r.expovariate(0.3))))}" for _ in range(r.randrange(30))]
        rare = [f"{s}{chr(97 + r.randrange(5))}é" for _ in range(r.randrange(4))] + [f"r{chr(97 + (i + r.randrange(3)) % 7)}" for _ in range(2) if s in ("s1", "s2", "s3")]
        rows.append((r.choice(["en", "de", None]), s if r.random() > 0.02 else None, " ".join(common + rare) if r.random() > 0.03 else None))
    return rows


@pytest.mark.parametrize("heavy, most, block, size", [(8, 1024, 128, 1024), (1, 1024, 3, 4), (1000, 1024, 2, 3), (2, 2, 4, 1)])
def test_splits(spark, monkeypatch, heavy, most, block, size):
    for name, value in (("HEAVY", heavy), ("MOST", most), ("BLOCK", block), ("TERMS", size)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(heavy, 12, 600)
    want = plain(rows, least=3)
    assert {r[2] for r in want} == {"pair", "term"}
    # Workers import the module afresh, so a tile's block is told by its rows there; only the deal is changed here.
    if block != 128:
        monkeypatch.setattr(divergence, "_tile", _with_block(block))
    assert got(spark, rows, least_docs=3) == want


def _with_block(block):
    def tile(rows):
        from loomgraph.llm import divergence as d

        d.BLOCK = block
        try:
            return d._tile(rows)
        finally:
            d.BLOCK = 128

    return tile


@pytest.mark.parametrize(("chunk", "held"), [(1, 4), (20, 8), (1 << 20, 1 << 20)])
def test_flushes(monkeypatch, chunk, held):
    """What a task counts by chunks and forgets in between adds up to the same postings."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [("en" if i % 3 else "de", f"s{i % 4}", f"alpha Beta x{chr(97 + i % 7)} alpha é" if i % 5 else "") for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    packed = sorted((r for b in divergence._count(3)(iter([batch, batch])) for r in b.to_pylist()), key=lambda r: r["bucket"])
    fields = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 6]
    again = [pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(r.values(), fields, strict=True)], list(r)) for r in packed]
    kept = [r for b in divergence._keep(20)(iter(again)) for r in b.to_pylist()]
    counts, docs = defaultdict(int), defaultdict(int)
    for lang, source, text in rows + rows:
        for t in re.findall(r"[a-zé]+", text.lower()):
            counts[lang, source, t] += 1
        for t in set(re.findall(r"[a-zé]+", text.lower())):
            docs[lang, t] += 1
    want = {k: n for k, n in counts.items() if docs[k[0], k[2]] >= 20}
    assert {(r["lang"], r["source"], r["term"]): r["count"] for r in kept} == want and len(kept) == len(want)
    assert sum(r["first"] for r in kept) == len({r["id"] for r in kept}) == len({(k[0], k[2]) for k in want})
    assert all(r["lang_count"] == sum(n for k, n in want.items() if (k[0], k[2]) == (r["lang"], r["term"])) and r["groups"] == sum((k[0], k[2]) == (r["lang"], r["term"]) for k in want) for r in kept)


def test_odd_rows(spark):
    """Null and empty fields, repeated rows, a language without kept terms, one source only, a very long text and a very long term."""
    long = " ".join(["word", "other"] * 50_000) + " " + "z" * 200_000
    rows = [(None, None, None), ("", "", ""), ("xx", "a", "one two"), ("xx", "b", "three"), ("yy", "only", "again again")] + [("en", "a", "Same TEXT")] * 12 + [("en", "b", long)] * 10 + [("en", "c", None), ("en", None, "1234 !!")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert {(r[0], r[2]) for r in got(spark, [("xx", s, "a b") for s in "ab"])} == {("xx", "pair")}


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([((1 << 61) + 1, (1 << 62) + 5, 1 << 20)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * ((1 << 61) + 3) // ((1 << 62) + 5 + (1 << 21))
