"""The classifier's query against a plain one: features by loops over bytes, weights in a dict, one text after the other."""

import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomgraph.llm import quality, queries

M = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & M
    return x ^ (x >> 31)


def digest(word, kind):
    h = 0
    for c in reversed(word):  # the first byte has the power 0
        h = (h * (0x9E3779B97F4A7C15 | 1) + c + 1) & M
    return mixed((h + len(word) * 0xD6E8FEB86659FD93 + kind * 0x632BE59BD9B4E019) & M) % quality.SIZE


def band(share, cuts):
    return sum(share >= c for c in cuts)


def plain_features(text):
    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return set()
    out = {digest(w, 1) for w in words} | {digest(w[:4], 2) for w in words} | {digest(w[:5], 3) for w in words} | {digest(w[-3:], 4) for w in words}
    n = max(1, sum(c not in b" \n" for c in raw))
    letters, capitals, high = (sum(f(c) for c in raw) for f in (lambda c: 97 <= c | 32 <= 122, lambda c: 65 <= c <= 90, lambda c: c >= 128))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 1 - len({digest(w, 1) for w in words}) / len(words)
    shares = [
        band(capitals / max(1, letters), quality._SHARES), band(1 - (letters + high) / n, quality._SHARES), band(repeated, quality._SHARES), band(1 - len(set(lines)) / max(1, len(lines)), quality._SHARES),
        band(n / len(words), quality._LONG), band(len(words), quality._MANY), band(raw.count(b" | ") / len(words), quality._SHARES), band(repeated, quality._SHARES) * 8 + band(len(words), quality._MANY),
    ]
    return out | {mixed((kind << 32 | b) + 0xA0761D6478BD642F & M) % quality.SIZE for kind, b in enumerate(shares, 1)}


def logistic(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def plain_fit(rows, grades):
    """Weights and thresholds by steps over batches, every text on its own."""
    top = max(grades)
    shares = [min(1 - 1e-3, max(1e-3, sum(g >= k for g in grades) / len(grades))) for k in range(1, top + 1)]
    b = np.maximum.accumulate([-math.log(s / (1 - s)) + 1e-2 * i for i, s in enumerate(shares)])
    often = [max(1, grades.count(k)) for k in range(top + 1)]
    weight = [math.sqrt(len(grades) / n / (top + 1)) for n in often]
    w, seen, b_seen, rng = {}, {}, np.zeros(top), np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), quality.BATCH):
            pick, g, gb = order[at : at + quality.BATCH], {}, np.zeros(top)
            for i in pick:
                y, scale = grades[i], 1 / math.sqrt(max(len(rows[i]), 50) / 50)
                s = scale * sum(w.get(f, 0.0) for f in rows[i])
                above, over = 1.0 if y == 0 else logistic(s - b[y - 1]), 0.0 if y == top else logistic(s - b[y])
                width = max(above - over, 1e-9)
                for f in rows[i]:
                    g[f] = g.get(f, 0.0) - (1 - above - over) * weight[y] * scale / len(pick)
                if y > 0:
                    gb[y - 1] += weight[y] * above * (1 - above) / width
                if y < top:
                    gb[y] -= weight[y] * over * (1 - over) / width
            for f, d in g.items():
                seen[f] = seen.get(f, 0.0) + d * d
                step = quality.RATE / (math.sqrt(seen[f]) + 1e-8)
                moved = w.get(f, 0.0) - step * d
                w[f] = math.copysign(max(abs(moved) - step * quality.L1, 0.0), moved)
            gb /= len(pick)
            b_seen += gb * gb
            b = np.maximum.accumulate(b - quality.RATE / (np.sqrt(b_seen) + 1e-8) * gb)
            b = b + 1e-3 * np.arange(top) * (np.diff(b, prepend=b[0] - 1) <= 0)
    return w, b


def test_query_against_plain(spark, small):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    labels = [r for r in pq.read_table(f"{small}/labels.parquet").to_pylist() if r["quality"] is not None and r["toxic"] is not None and r["doc_id"] in docs]
    made = {i: plain_features(t) for i, t in docs.items()}
    ids = spark.createDataFrame([(r["doc_id"],) for r in labels], "d long").select("d", F.xxhash64("d", F.lit("rated")).alias("h")).collect()
    hashes = {r["d"]: r["h"] for r in ids}
    rated = sorted(((hashes[r["doc_id"]], 0 if r["quality"] == 0 else 1 if r["toxic"] == 1 else 2, r["doc_id"]) for r in labels if made[r["doc_id"]]))
    w, b = plain_fit([sorted(made[i]) for *_, i in rated], [g for _, g, _ in rated])
    got = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, small).collect()}
    assert got.keys() == docs.keys() and len(rated) > 50
    for i, f in made.items():
        s = sum(w.get(x, 0.0) for x in f) / math.sqrt(max(len(f), 50) / 50)
        tails = [logistic(s - t) if f else 0.0 for t in b]
        assert abs(got[i]["tail_probability"] - tails[-1]) < 1e-4 and abs(got[i]["expected_grade"] - sum(tails)) < 2e-4
        assert got[i]["keep"] == (tails[-1] >= 0.5) or abs(tails[-1] - 0.5) < 1e-4
