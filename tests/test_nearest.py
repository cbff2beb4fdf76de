"""Best partners against all pairs, whatever the blocks; what the bound skips; precision and recall from best partners against those from pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import matching, nearest

SCHEMA = "doc string, item long, v array<float>"


def made(seed, n, dims=6, docs=("a", "b", None), hot="a"):
    r = np.random.default_rng(seed)
    rows = [(hot if r.random() < 0.5 else docs[r.integers(len(docs))], i, [float(np.float32(x)) for x in r.normal(size=dims)]) for i in range(n)]
    return rows + [("a", n, rows[0][2]), ("a", n + 1, rows[0][2]), ("lonely", n + 2 + seed % 2, [1.0] * dims), ("a", n + 5, None), ("a", None, [1.0] * dims)]


def plain(asking, other):
    out = {}
    for d, i, v in asking:
        mine = [(-round(float(np.dot(v, w)), 12), j) for e, j, w in other if e == d and d is not None and j is not None and w is not None] if i is not None and v is not None else []
        if mine:
            s, j = min(mine)
            out[d, i] = (j, -s)
    return out


@pytest.mark.parametrize(("block", "part"), [(1024, 64), (10, 3), (1, 1)])
def test_best_partners(spark, monkeypatch, block, part):
    monkeypatch.setattr(nearest, "BLOCK", block)
    asking, other = made(2, 60), made(3, 80)
    left, right = spark.createDataFrame(asking, SCHEMA), spark.createDataFrame(other, SCHEMA).withColumnRenamed("item", "partner")
    got = nearest.best_partners(left, right).collect()
    want = plain(asking, other)
    assert {(r["doc"], r["item"]) for r in got} == set(want) and len(got) == len(want)
    assert all((r["partner"], round(r["similarity"], 9)) == (want[r["doc"], r["item"]][0], round(want[r["doc"], r["item"]][1], 9)) for r in got)
    assert nearest.best_partners(left.limit(0), right).count() == 0 and nearest.best_partners(left, right.limit(0)).count() == 0


def test_bound_skips(spark):
    """Items in clusters: most parts cannot hold a better partner and are not looked into."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 16)) * 10
    rows = lambda n, k: [("d", i, [float(x) for x in centres[i % k] + r.normal(size=16) * 0.1]) for i in range(n)]
    asking, other = rows(40, 1), rows(2000, 8)
    got = nearest.best_partners(spark.createDataFrame(asking, SCHEMA), spark.createDataFrame(other, SCHEMA).withColumnRenamed("item", "partner")).collect()
    assert {r["item"]: r["partner"] for r in got} == {i: j for (_, i), (j, _) in plain(asking, other).items()}
    assert got[0]["parts"] >= 30 and max(r["looked"] for r in got) < 0.6 * got[0]["parts"]


@pytest.mark.parametrize("share", [None, 0.5, 0.75])
def test_precision_and_recall(spark, share):
    keep = lambda rows: [r for r in rows if None not in r and r[0] != "lonely"]
    f, p = spark.createDataFrame(keep(made(6, 40)), SCHEMA), spark.createDataFrame(keep(made(7, 50)), SCHEMA)
    pairs = f.select("doc", F.col("item").alias("feature"), F.col("v").alias("x")).join(p.select("doc", F.col("item").alias("phrase"), F.col("v").alias("y")), "doc").select("doc", "feature", "phrase", scalars.dot(F.col("x"), F.col("y")).alias("similarity"))
    want = (matching.soft_hard_prf(pairs) if share is None else matching.topk_prf(pairs, share)).collect()
    got = {r["doc"]: r for r in matching.prf_of_vectors(f, p, share).collect()}
    assert {r["doc"] for r in want} == set(got) and len(want) == 2
    for r in want:
        for c in ("precision", "recall", "f1", "f1_soft", "f1_hard"):
            assert got[r["doc"]][c] == pytest.approx(r[c], abs=1e-9)
