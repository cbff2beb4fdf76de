"""Source divergence audit: how far the sources of a language are from each other in their terms, exactly.

A term's share p in a group (a source within a language) is smoothed and scaled to an integer; two shares differ by f = floor((p - q)^2 / (p + q)), and two sources by the sum of f over all terms their language keeps.

Method (heavy-light split): a group without a term has the share p0 that its totals fix, so a pair of groups g, h begins with V * f(p0_g, p0_h) for V terms, and only terms that one of them has correct it.
Terms that many groups of a language have (at least one in HEAVY of them) are laid out in dense tiles, a block of groups by a block of groups by a block of terms, and summed as numpy arrays. Other terms are
postings: what a posting of g corrects against groups without the term depends on its share alone, so it is summed by a histogram of g's shares, and groups that both have the term are corrected pair by pair
within the term's postings, of which there are at most MOST. All sums are of 64-bit integers, so the parts add exactly and in any order.

Scale and skew: a task counts its documents' terms as arrays, by chunks of text that are merged, and forgets them beyond HELD entries; what it knows leaves it as one packed row for each bucket of terms, so a source with a third
of all rows, or a term that every document has, sends a task's entry for it and no row for each document. There are BUCKETS buckets for each input partition, so a bucket is as large as a part of a task's counts however many tasks there are. The task
that merges a bucket knows all about its terms and drops those that too few documents have, exactly, before anything else is computed. Tiles have at most 2 * BLOCK groups and about TERMS terms, a light term's postings are bounded, and
only sums by pair leave a task. The result has a row for each ordered pair of a language's sources, as the audit is defined.

Defined results: null text, language or source is the empty string. Repeated rows and rows without an id count. A language that keeps no term has the value 0 for each pair and no term rows; a source without kept terms has its smoothed
shares; a language with one source has no pairs. Long texts are counted whole; columns besides text, language and source are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_DOCS = 10
TOP_TERMS = 10
ONE = 1_000_000_000
HEAVY = 8
MOST = 1024
BLOCK, TERMS = 128, 1024
#: Text bytes counted at once, and counted entries (terms of a group) that a task holds.
CHUNK, HELD = 8 << 20, 2_000_000
#: Buckets of terms for each partition of the input.
BUCKETS = 8

_TERM = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in common.LOWER)
_PACKED = "bucket int, groups array<string>, letters binary, lengths binary, term binary, `group` binary, count binary, docs binary"
_KEPT = "lang string, source string, term string, id long, count long, groups int, lang_count long, first boolean"
_SUMS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())])


@dataclass
class Counts:
    """Entries of terms in groups: places in a list of distinct terms and in one of groups, occurrences, documents."""

    terms: pa.Array
    term: np.ndarray
    group: np.ndarray
    count: np.ndarray
    docs: np.ndarray


def _binary(letters: bytes, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, sums of each of the values by key)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(key) else v[:0] for v in values)


def counted(texts: list[bytes], groups: list[int]) -> Counts:
    """The terms of some texts by their groups."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    a = np.frombuffer(b" ".join(texts).translate(_TERM) + b" ", dtype=np.uint8)
    inside = a != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate(([0], edge)) if inside[0] else edge
    start, end = edge[::2], edge[1::2]
    coded = _binary(a[inside].tobytes(), end - start).dictionary_encode()
    n = max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, at)))
    key, count = _summed(doc * n + coded.indices.to_numpy(), np.ones(len(doc), dtype=np.int64))
    key, count, docs = _summed(np.asarray(groups, dtype=np.int64)[key // n] * n + key % n, count, np.ones(len(key), dtype=np.int64))
    return Counts(coded.dictionary, key % n, key // n, count, docs)


def merged(parts: list[Counts]) -> Counts:
    """Entries of several parts, whose groups are numbered alike, as one."""
    coded = pa.chunked_array([p.terms for p in parts]).combine_chunks().dictionary_encode()
    code, n = coded.indices.to_numpy(), max(1, len(coded.dictionary))
    begin = np.cumsum([0, *(len(p.terms) for p in parts)])
    key = np.concatenate([p.group * n + code[p.term + b] for p, b in zip(parts, begin, strict=False)])
    key, count, docs = _summed(key, np.concatenate([p.count for p in parts]), np.concatenate([p.docs for p in parts]))
    return Counts(coded.dictionary, key % n, key // n, count, docs)


def _packed_rows(c: Counts, names: list[tuple[str, str]], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of terms."""
    if not len(c.term):
        return
    with np.errstate(over="ignore"):
        of = (common.hash_words(b" ".join(c.terms.to_pylist())) % np.uint64(buckets)).astype(np.int64)[c.term]
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        some = order[lo:hi]
        own, term = np.unique(c.term[some], return_inverse=True)
        groups, group = np.unique(c.group[some], return_inverse=True)
        taken = c.terms.take(pa.array(own)).to_pylist()
        told = [x for g in groups for x in names[g]]
        arrays = np.array([len(t) for t in taken], dtype=np.int64), term.astype(np.int32), group.astype(np.int32), c.count[some], c.docs[some]
        values = [int(of[some[0]]), told, b"".join(taken), *(x.tobytes() for x in arrays)]
        kinds = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["bucket", "groups", "letters", "lengths", "term", "group", "count", "docs"])


def _count(buckets: int):
    """Rows (lang, source, text) of a task to packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        parts: list[Counts] = []
        texts, groups, size = [], [], 0

        def entries() -> int:
            return sum(len(p.term) for p in parts)

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = common.as_bytes(text.as_py())
                if texts and size + len(t) > CHUNK:
                    parts.append(counted(texts, groups))
                    texts, groups, size = [], [], 0
                    if entries() > HELD:
                        parts = [merged(parts)]
                        if entries() > HELD // 2:
                            yield from _packed_rows(parts[0], list(numbers), buckets)
                            parts, numbers = [], {}
                texts.append(t)
                groups.append(numbers.setdefault((lang, source), len(numbers)))
                size += len(t)
        if texts:
            parts.append(counted(texts, groups))
        if parts:
            yield from _packed_rows(merged(parts), list(numbers), buckets)

    return run


def _keep(least: int):
    """Packed rows, sorted by bucket, to the postings of the terms that enough documents of their language have."""

    def bucket(number: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        parts = []
        for r in rows:
            own = np.array([names.setdefault(g, len(names)) for g in zip(r["groups"][::2], r["groups"][1::2], strict=True)])
            ints = [np.frombuffer(r[c], dtype=k) for c, k in (("lengths", np.int64), ("term", np.int32), ("group", np.int32), ("count", np.int64), ("docs", np.int64))]
            parts.append(Counts(_binary(r["letters"], ints[0]), ints[1].astype(np.int64), own[ints[2]], ints[3], ints[4]))
        c = merged(parts)
        langs: dict[str, int] = {}
        lang = np.array([langs.setdefault(x, len(langs)) for x, _ in names])[c.group]
        key = lang * max(1, len(c.terms)) + c.term
        own, docs, groups, count = _summed(key, c.docs, np.ones(len(key), dtype=np.int64), c.count)
        place = np.searchsorted(own, key)
        some = np.flatnonzero(docs[place] >= least)
        some = some[np.argsort(place[some], kind="stable")]
        place = place[some]
        first = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, dtype=bool)
        both = list(names)
        for i in range(0, len(some), 50_000):
            s, p = some[i : i + 50_000], place[i : i + 50_000]
            told = [both[g] for g in c.group[s]]
            words = pa.array([t.decode("utf-8", "surrogatepass") for t in c.terms.take(pa.array(c.term[s])).to_pylist()], pa.string())
            columns = [pa.array([x for x, _ in told], pa.string()), pa.array([y for _, y in told], pa.string()), words, pa.array((number << 32) + p), pa.array(c.count[s]), pa.array(groups[p].astype(np.int32)), pa.array(count[p]), pa.array(first[i : i + 50_000])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "id", "count", "groups", "lang_count", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now:
                    if rows:
                        yield from bucket(now, rows)
                    now, rows = r["bucket"], []
                rows.append(r)
        if rows:
            yield from bucket(now, rows)

    return run


def postings(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, id, count, groups, lang_count, first) of the terms that at least ``least`` documents of their language have; rows: lang, source, text.

    id numbers a language's term, groups are the sources of the language that have it, lang_count its occurrences there, and one row of each id is the first.
    """
    spark = rows.sparkSession
    buckets = BUCKETS * max(1, rows.rdd.getNumPartitions())
    packed = rows.mapInArrow(_count(buckets), _PACKED)
    return packed.repartition(min(buckets, 4 * common.partitions(spark)), "bucket").sortWithinPartitions("bucket").mapInArrow(_keep(least), _KEPT)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE * (count + 2) / (total + 2 * kept)), exact for any counts; null for a language that keeps no term."""
    of = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), of))


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of two arrays of shares."""
    d = p - q
    return d * d // (p + q)


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums by pair (lang, g, h; g before h) of one tile: rows of kind 0 are groups (p: their p0, n: V), of kind 1 histogram cells (n light terms of share p), of kind 2 heavy postings.

    A tile without heavy terms (t < 0) gives V * f(p0, p0) and the corrections by histogram; any other what its terms correct.
    """
    groups = rows[rows["kind"] == 0].sort_values("at")
    at, p0, kept = groups["at"].to_numpy(), groups["p"].to_numpy(), groups["n"].to_numpy()
    a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    left, right = np.flatnonzero(at // BLOCK == a), np.flatnonzero(at // BLOCK == b)
    sums = np.zeros((len(left), len(right)), dtype=np.int64)
    if rows["t"].iloc[0] < 0:
        for i, g in enumerate(left):
            sums[i] = kept[g] * apart(p0[g], p0[right])
        cells = rows[rows["kind"] == 1]
        for own, other, flip in ((left, right, False), (right, left, True)):
            for g, part in cells.groupby(np.searchsorted(at, cells["at"].to_numpy())):
                place = np.searchsorted(own, g)
                if place < len(own) and own[place] == g:
                    p, n = part["p"].to_numpy(), part["n"].to_numpy()
                    for j, h in enumerate(other):
                        sums[(j, place) if flip else (place, j)] += int((n * (apart(p, p0[h]) - apart(p0[g], p0[h]))).sum())
    else:
        cells = rows[rows["kind"] == 2]
        term, names = pd.factorize(cells["term"])
        shares = np.repeat(p0[:, None], len(names), axis=1)
        shares[np.searchsorted(at, cells["at"].to_numpy()), term] = cells["p"].to_numpy()
        for i, g in enumerate(left):
            sums[i] = apart(shares[g], shares[right]).sum(axis=1) - len(names) * apart(p0[g], p0[right])
    g, h = np.meshgrid(at[left], at[right], indexing="ij")
    told = g < h
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "g": g[told], "h": h[told], "value": sums[told]})


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by pair of what light terms correct in groups that both have them; rows (lang, id, at, p, p0) come sorted by id and at."""
    waiting = None

    def sums(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        at, p, p0 = (rows[c].to_numpy() for c in ("at", "p", "p0"))
        lang, names = pd.factorize(rows["lang"])
        term = rows["id"].to_numpy()
        start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        size = np.diff(np.r_[start, len(rows)])
        for m in np.unique(size[size > 1]):
            i, j = np.triu_indices(m, 1)
            runs = start[size == m]
            step = max(1, (1 << 20) // len(i))
            for k in range(0, len(runs), step):
                x, y = (runs[k : k + step, None] + i).ravel(), (runs[k : k + step, None] + j).ravel()
                value = apart(p[x], p[y]) - apart(p[x], p0[y]) - apart(p0[x], p[y]) + apart(p0[x], p0[y])
                pairs, inverse = np.unique(np.stack([lang[x], at[x], at[y]]), axis=1, return_inverse=True)
                total = np.zeros(pairs.shape[1], dtype=np.int64)
                np.add.at(total, inverse.ravel(), value)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(names)[pairs[0]], pa.string()), pa.array(pairs[1], pa.int64()), pa.array(pairs[2], pa.int64()), pa.array(total)], schema=_SUMS)

    for b in batches:
        rows = b.to_pandas()
        if waiting is not None:
            rows = pd.concat([waiting, rows], ignore_index=True)
        if not len(rows):
            continue
        last = rows["id"] == rows["id"].iloc[-1]
        waiting, rows = rows[last], rows[~last]
        if len(rows):
            yield from sums(rows)
    if waiting is not None and len(waiting):
        yield from sums(waiting)


def _pair_sums(stats: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, g, h, value) of each pair of a language's groups, g before h; stats (lang, at, sources, kept, p0), postings (lang, id, at, groups, sources, kept, p, p0)."""
    heavy = (F.col("groups") * HEAVY >= F.col("sources")) | (F.col("groups") > MOST)
    light = postings.filter(~heavy)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / BLOCK)))
    tiles = F.floor((F.col("kept") - 1) / TERMS)
    own = F.floor(F.col("at") / BLOCK)
    cell = lambda kind, p, n, term, t: (F.lit(kind).alias("kind"), "at", p.alias("p"), n.alias("n"), term.alias("term"), t.alias("t"), other.alias("o"))
    none = F.lit(-1).cast("long")
    of_groups = stats.withColumn("t", F.explode(F.sequence(F.lit(-1).cast("long"), tiles))).select("lang", *cell(0, F.coalesce("p0", F.lit(1)), F.col("kept"), none, F.col("t")))
    of_light = light.groupBy("lang", "at", "sources", "p").agg(F.count("*").alias("n")).select("lang", *cell(1, F.col("p"), F.col("n"), none, none))
    of_heavy = postings.filter(heavy).select("lang", *cell(2, F.col("p"), F.lit(1).cast("long"), F.col("id"), F.pmod(F.xxhash64("id"), tiles + 1)))
    rows = of_groups.unionByName(of_light).unionByName(of_heavy)
    dealt = rows.select("lang", F.least(own, "o").alias("a"), F.greatest(own, "o").alias("b"), "t", "kind", "at", "p", "n", "term")
    kind = "lang string, g long, h long, value long"
    by_tile = dealt.groupBy("lang", "a", "b", "t").applyInPandas(_tile, kind)
    sorted_light = light.filter(F.col("groups") > 1).select("lang", "id", "at", "p", "p0").repartition(common.partitions(stats.sparkSession), "id").sortWithinPartitions("id", "at")
    return by_tile.unionByName(sorted_light.mapInArrow(_both, kind)).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language, part ``term`` the terms that the source uses more than its language does, those with the largest f."""
    common.ship(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = common.saved(postings(rows, least_docs), "divergence-kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count_if("first").alias("firsts"))
    at, of_lang = Window.partitionBy("lang").orderBy("source"), Window.partitionBy("lang")  # a row for each source
    none = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce(F.sum("firsts").over(of_lang), none).alias("kept"), F.coalesce(F.sum("total").over(of_lang), none).alias("lang_total"), (F.row_number().over(at) - 1).cast("long").alias("at"), F.count("*").over(of_lang).alias("sources"))
    stats = common.saved(groups.withColumn("p0", share(none, F.col("total"), F.col("kept"))), "divergence-groups")
    told = kept.join(stats, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("kept")))

    sums = _pair_sums(stats, told)
    both = sums.select("lang", "value", F.explode(F.array(*(F.struct(F.col(x).alias("at"), F.col(y).alias("other")) for x, y in (("g", "h"), ("h", "g"))))).alias("s")).select("lang", "value", "s.*")
    named = both.join(stats.select("lang", "at", "source"), ["lang", "at"]).join(stats.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    q, p = share(F.col("lang_count"), F.col("lang_total"), F.col("kept")), F.col("p")
    used = told.withColumn("q", q).filter(F.col("p") > F.col("q")).withColumn("value", F.call_function("div", (p - F.col("q")) * (p - F.col("q")), p + F.col("q")))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(ranks).alias("rank"))
    return ranked(named, "pair").unionByName(ranked(used.withColumnRenamed("term", "item"), "term").filter(F.col("rank") <= top))
