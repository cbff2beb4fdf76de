"""Neighbours ranked by all terms against a plain computation, and driver tables and templates on odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import construction, evaluation, models, neighborhood
from loomgraph.plans import catalog
from loomgraph.plans import harness as h
from tests import dense


def test_ranked_by_all_terms(spark, small):
    edges = h.edges(spark, small).select("src", "dst").toPandas()
    names = sorted({*edges["src"], *edges["dst"]})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    np.add.at(m, (edges["src"].map(at), edges["dst"].map(at)), 1)
    g = dense.green(m)
    g /= g.sum(axis=1, keepdims=True)
    kinds = {r["node_id"]: (r["type"], r["symbol"]) for r in h.nodes(spark, small).collect()}
    base = {(r["start"], r["node"]): r for r in neighborhood.ranked_khop(spark.createDataFrame([(f"supplier:{i}",) * 2 for i in range(10)], "start string, node string"), h.edges(spark, small), 2, 10**6).collect()}
    embed = lambda t: models.HashedNgrams().embed([t])[0].astype(float)
    texts = {n: embed(f"{symbol} [{kind}]") for n, (kind, symbol) in kinds.items()}
    asked = {s: embed(f"neighbours of {kinds[s][1]}") for s in {s for s, _ in base}}
    want = {}
    for (s, n), r in base.items():
        semantic = max(0.0, float(texts[n] @ asked[s] / np.linalg.norm(texts[n]) / np.linalg.norm(asked[s])))
        score = 0.25 * (1 - (r["hops"] - 1) / 2) + 0.4 * r["evidence"] + 0.1 * r["prob"] + 0.05 * g[at[s], at[n]] + 0.2 * semantic
        want.setdefault(s, []).append((-round(score, 6), n, round(semantic, 6)))
    got = catalog.QUERIES["ranked_khop_full"](spark, small).collect()
    assert len(got) == 20 * len(want)
    for r in got:
        told = {n: (-s, sem) for s, n, sem in want[r["start"]]}
        assert r["score"] == pytest.approx(told[r["node"]][0], abs=3e-6) and r["semantic"] == pytest.approx(told[r["node"]][1], abs=3e-6)
        assert r["score"] >= -sorted(want[r["start"]])[19][0] - 3e-6


def test_likeness_without_texts(spark):
    pairs = spark.createDataFrame([("s", "a"), ("s", "none"), ("t", "a")], "start string, node string")
    got = {(r["start"], r["node"]): r["semantic"] for r in neighborhood.likeness(pairs, spark.createDataFrame([("s", "alpha beta")], "start string, text string"), spark.createDataFrame([("a", "alpha beta"), ("b", None)], "node string, text string")).collect()}
    assert got["s", "a"] == pytest.approx(1) and got["s", "none"] == got["t", "a"] == 0


def test_driver_columns(spark):
    genes, tumors = spark.createDataFrame([(" kras",)], "symbol string"), spark.createDataFrame([("BRCA",), ("COAD-X",)], "tumor string")
    rows = [(" Kras ", "tcga-brca", "Act", 0.1, 1), ("KRAS", "BRCA-US", None, None, 2), ("KRAS", "coad-x", "", 0.2, 3), ("TP53", "BRCA", "", 0.3, 4), ("KRAS", "LUAD", "", 0.4, 5), (None, "BRCA", "", 0.5, 6)]
    got = construction.driver_rows(spark.createDataFrame(rows, "`Gene_Name` string, Cancer_Type string, mode_of_action string, FDR double, seq int"), genes, tumors).orderBy("seq").collect()
    assert [(r["tumor"], r["gene"], r["role"], r["score"]) for r in got] == [("BRCA", "KRAS", "Act", "0.1"), ("BRCA", "KRAS", "", ""), ("COAD-X", "KRAS", "", "0.2")]
    assert construction.driver_rows(spark.createDataFrame([("KRAS", 1)], "x string, seq int"), genes, tumors).count() == 0


def test_filled(spark):
    got = spark.createDataFrame([("{b}", None)], "a string, b string").select(evaluation.filled("{a}-{b}-{c}-{a}", a=F.col("a"), b=F.col("b")).alias("t")).first()["t"]
    assert got == "{b}--{c}-{b}" and scalars.NEIGHBOR_WEIGHTS["semantic"] == 0.2
