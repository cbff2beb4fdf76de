"""Tiled correlations against numpy, pair by pair, whatever the tiles; what the bound drops; what is shuffled."""

import numpy as np
import pytest

from loomgraph.operators import construction, tiles

SCHEMA = "cell string, gene string, effect double"


def plain(rows, least):
    by = {}
    for c, g, e in rows:
        if None not in (c, g, e):
            by.setdefault(g, []).append((c, e))
    out = {}
    for a in by:
        for b in by:
            if a < b:
                x, y = np.array([(u, v) for c, u in by[a] for d, v in by[b] if c == d]).reshape(-1, 2).T
                if len(x) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0:
                    r = np.corrcoef(x, y)[0, 1]
                    if abs(r) >= least:
                        out[a, b] = r
    return out


def got(spark, rows, least, **sizes):
    return {(r["a"], r["b"]): r["corr"] for r in tiles.correlations(spark.createDataFrame(rows, SCHEMA), least, **sizes).collect()}


def matrix(seed, cells, genes, share=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(cells, 3))
    return [(f"c{i}", f"g{j}", float(1e5 * (j % 2) + base[i, j % 3] + rng.normal())) for i in range(cells) for j in range(genes) if rng.random() < share]


@pytest.mark.parametrize(("genes", "cells", "share"), [(512, 1024, 1.0), (4, 7, 1.0), (5, 6, 0.6), (1, 1, 0.5)])
def test_against_pairs(spark, genes, cells, share):
    rows = matrix(genes, 25, 14, share)
    want = plain(rows, 0.2)
    found = got(spark, rows, 0.2, genes=genes, cells=cells)
    assert found.keys() == want.keys() and len(want) > 5
    assert all(abs(found[k] - want[k]) < 1e-8 for k in want)


def test_odd_rows(spark):
    """Repeated cells, nulls, a gene without variance, genes without common cells, no rows."""
    rows = matrix(9, 12, 5, 0.9) + [("c1", "g0", 5.0), ("c1", "g0", 6.0), ("c2", "g1", 7.0), (None, "g1", 1.0), ("c3", None, 1.0), ("c3", "g1", None)]
    rows += [(f"c{i}", "flat", 2.0) for i in range(12)] + [("d1", "far", 1.0), ("d2", "far", 2.0), ("c1", "one", 1.0)]
    want = plain(rows, 0.0)
    found = got(spark, rows, 0.0, genes=2, cells=4)
    assert found.keys() == want.keys() and not any({"flat", "far", "one"} & set(k) for k in found)
    assert all(abs(found[k] - want[k]) < 1e-8 for k in want)
    assert got(spark, [], 0.1) == {}


def test_bound_drops_tiles(spark):
    """Genes that vary in different cells only cannot correlate: their tiles are dropped, and the rows stay the same."""
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", f"g{j}", float(rng.normal() * (50 if i // 40 == j // 10 else 0.001))) for i in range(160) for j in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, placed, norms = tiles.packed(df, genes=4, cells=1)
    blocks = placed.select("b").distinct().count()
    meeting = tiles.tiles(norms, 0.3).count()
    assert blocks > 10 and blocks <= meeting < 0.85 * blocks * (blocks + 1) / 2
    want = plain(rows, 0.3)
    found = got(spark, rows, 0.3, genes=4, cells=1)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_pairs_are_not_rows(spark):
    """Ten times the genes send each packed value to ten times the blocks; no stage has a row for each pair of genes and cell."""
    sent = {}
    for n in (20, 200):
        rows, _, norms = tiles.packed(spark.createDataFrame(matrix(n, 30, n), SCHEMA), genes=10, cells=15)
        meeting = tiles.tiles(norms, 0.0)
        sent[n] = (rows.count(), meeting.count())
    assert sent[200][0] <= 20 * sent[20][0] and sent[200][1] <= 20 * 21 * 3 and sent[200][0] * 200 < 30 * 200 * 199 / 2


def test_strongest(spark):
    rows = matrix(4, 40, 12)
    want = sorted(plain(rows, 0.15).items(), key=lambda kv: (-round(abs(kv[1]), 12), kv[0]))[:7]
    assert [(r["a"], r["b"]) for r in construction.codependencies(spark.createDataFrame(rows, SCHEMA), most=7).collect()] == [k for k, _ in want]
