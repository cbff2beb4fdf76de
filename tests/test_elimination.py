"""Ranks by elimination against rounds and against what can be reached."""

import numpy as np
import pytest

from loomgraph.operators import pagerank


def held(src, dst, n):
    """A graph as tasks hold it."""
    ends, count = np.unique(np.stack([dst, src]), axis=1, return_counts=True)
    dst, src = ends
    w = count / np.bincount(src, count, n)[src]
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    return src, w, first, dst[first], dst


@pytest.mark.parametrize("kind", ["bipartite", "loops", "chain", "tree"])
def test_elimination(kind):
    r = np.random.default_rng(5)
    n = 60
    if kind == "bipartite":
        a, b = r.integers(0, 8, 300), r.integers(8, n, 300)
        src, dst = np.r_[a[:150], b[150:]], np.r_[b[:150], a[150:]]
    elif kind == "loops":
        src, dst = r.integers(0, n, 120), r.integers(0, n, 120)
        src, dst = np.r_[src, 3, 4], np.r_[dst, 3, 4]
    elif kind == "chain":
        src, dst = np.arange(n - 1), np.arange(1, n)
    else:
        src, dst = (np.arange(1, n) - 1) // 2, np.arange(1, n)
    src, w, first, targets, dst = held(src, dst, n)
    out = pagerank.independent(src, dst, n)
    assert not (out[src] & out[dst]).any() and out.any()
    solved = pagerank.eliminated(src, w, first, targets, n, 0.85)
    step = np.zeros((n, n))
    step[dst, src] = w
    for at in range(n):
        seen = np.zeros(n, dtype=bool)
        seen[at] = True
        for _ in range(n):
            seen |= (step[:, seen] > 0).any(axis=1)
        x = solved(at)
        assert np.abs(np.eye(n)[at] + 0.85 * step @ x - x).sum() < 1e-14
        assert ((x > 0) == seen).all() and (x >= 0).all()


def test_large_rest_is_left_to_gradients(monkeypatch):
    src, w, first, targets, _ = held(np.arange(9), np.arange(1, 10), 10)
    monkeypatch.setattr(pagerank, "DENSE", 2)
    assert pagerank.eliminated(src, w, first, targets, 10, 0.85) is None


def test_stars_keep_components(spark, monkeypatch):
    from loomgraph.operators import components

    monkeypatch.setattr(components, "HELD", 50)
    r = np.random.default_rng(2)
    a = [f"n{x}" for x in r.integers(0, 300, 3000)]
    rows = [(x, f"n{(int(x[1:]) + 3 * int(k)) % 300}") for x, k in zip(a, r.integers(0, 4, 3000), strict=True)] + [("x", None), ("y", "y"), ("u", "v")]
    edges = spark.createDataFrame(rows, "a string, b string").repartition(3)
    thin = components.stars(edges)
    assert thin.count() < edges.count()
    assert sorted(map(tuple, components.connected_components(thin).collect())) == sorted(map(tuple, components.connected_components(edges).collect()))


def test_rounded_is_round(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions import scalars

    r = np.random.default_rng(1)
    x = [*r.random(2000).tolist(), *(r.integers(0, 10**7, 2000) / 1e7).tolist(), *(r.random(500) * 2000).tolist(), 0.9151282884999999, 5e-7, 4.999999999999999e-7, 999.9999995, 0.0, -0.0000005, -1.5, 1e300, float("inf")]
    made = spark.createDataFrame([(v,) for v in x], "x double")
    for digits in (6, 8):
        assert made.filter(~F.round("x", digits).eqNullSafe(scalars.rounded(F.col("x"), digits))).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(scalars.rounded(F.col("x"), 6).alias("y")).collect()
    assert np.isnan(odd[0]["y"]) and odd[1]["y"] is None
