"""Answers without limits: nothing that the operators' definitions keep is left out."""

import re

import numpy as np
import pandas as pd
import pytest

from loomgraph.operators import graph, learning, models, neighborhood, pagerank, selection
from loomgraph.plans import catalog, explain
from loomgraph.plans import harness as h
from tests import dense


@pytest.fixture(scope="module")
def edges(spark, small):
    return h.edges(spark, small).select("src", "dst", "key", "type", "source", "evidence").toPandas()


def test_explanation_keeps_all_pathways(spark, small, edges):
    """Cores keep their best genes and their drugs within the caps; nothing limits the pathways beside them."""
    kind = h.nodes(spark, small).toPandas().set_index("node_id")["type"]
    got = catalog.QUERIES["explained_nodes"](spark, small).filter("type = 'pathway'").toPandas().groupby("pair_id")["node"].apply(set)
    near: dict[str, set] = {}
    for s, d in zip(edges["src"], edges["dst"], strict=True):
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    for p in h.pairs(spark, small).collect():
        assert got[p["pair_id"]] == {n for n in near[p["a"]] | near[p["b"]] if kind[n] == "pathway"}
    assert got.map(len).max() > 60
    s = explain.Settings()
    assert min(s.neighbors, s.max_nodes, s.max_edges) >= 10**9 and s.ppr_rounds is None


def test_removal_losses():
    r = np.random.default_rng(7)
    for _ in range(60):
        n = int(r.integers(3, 9))
        m = r.integers(0, 3, (n, n)) * (r.random((n, n)) < 0.35).astype(float)
        before = dense.dense_pagerank(m, 0, rounds=2000, tolerance=1e-16)[1]
        got = dense.removal_losses(m, dense.green(m), 0, 1)
        for i in range(2, n):
            rest = np.delete(np.delete(m, i, 0), i, 1)
            want = max(0.0, before - dense.dense_pagerank(rest, 0, rounds=2000, tolerance=1e-16)[1]) / before if before > 1e-9 else 0.0
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_losses_side_by_side(monkeypatch):
    """Blocks of removed nodes against the dense form, with sinks, loops, parallel edges and unreachable ends."""
    r = np.random.default_rng(17)
    for k in range(60):
        monkeypatch.setattr(pagerank, "CELLS", (10, 100, 1 << 20)[k % 3])
        n = int(r.integers(3, 12))
        m = r.integers(0, 3, (n, n)) * (r.random((n, n)) < 0.4).astype(float)
        if not m.any():
            continue
        src, dst = (np.repeat(x, m[np.nonzero(m)].astype(int)) for x in np.nonzero(m))
        got = pagerank.removal_losses(src, dst, n, 0, 1, np.arange(n))
        assert np.abs(got - dense.removal_losses(m, dense.green(m), 0, 1)).max() < 1e-8


def test_necessity_in_blocks(spark, small, monkeypatch):
    whole = catalog.QUERIES["necessity"](spark, small).toPandas().set_index(["pair_id", "node"]).sort_index()
    monkeypatch.setattr(pagerank, "CELLS", 50)
    edges, pairs = h.edges(spark, small), h.pairs(spark, small)
    members = graph.shortest_path_nodes(pairs, edges, 2)
    some = pagerank.necessity(graph.induced_edges(edges.select("src", "dst"), members), pairs).toPandas().set_index(["pair_id", "node"]).sort_index()
    assert whole.index.equals(some.index) and np.abs(whole["necessity"] - some["necessity"]).max() < 1e-9 and whole["necessity"].max() > 0.01


def test_fixed_rounds_held_and_joined(spark, monkeypatch):
    """The same rounds by either way, and only the wanted nodes."""
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (2, 1), (4, 1), (3, 5)], "src long, dst long")
    seeds = spark.createDataFrame([("x", 1), ("y", 4), ("z", 9)], "source_id string, node long")
    wanted = spark.createDataFrame([("x", 3), ("x", 77), ("y", 1), ("z", 9), ("q", 1)], "source_id string, node long")
    told = []
    for held in (pagerank.HELD, 0):
        monkeypatch.setattr(pagerank, "HELD", held)
        whole = {(r["source_id"], r["node"]): r["rank"] for r in pagerank.personalized_pagerank(e, seeds, rounds=3).collect()}
        few = {(r["source_id"], r["node"]): r["rank"] for r in pagerank.personalized_pagerank(e, seeds, rounds=3, at=wanted).collect()}
        assert few == {k: v for k, v in whole.items() if k in {("x", 3), ("y", 1), ("z", 9)}} and len(few) == 3
        told.append(whole)
    assert told[0].keys() == told[1].keys() and all(told[0][k] == pytest.approx(told[1][k]) for k in told[0])


def test_held_and_joined_pagerank(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (2, 1), (4, 1), (3, 5)], "src long, dst long")
    seeds = spark.createDataFrame([("x", 1), ("y", 4), ("z", 9)], "source_id string, node long")
    held = pagerank.personalized_pagerank(e, seeds).toPandas()
    monkeypatch.setattr(pagerank, "HELD", 0)
    joined = pagerank.personalized_pagerank(e, seeds).toPandas()
    both = pd.merge(held, joined, on=["source_id", "node"], how="outer")
    assert len(both) == 5 + 5 and np.abs(both["rank_x"] - both["rank_y"]).max() < 1e-12


def _adaptive(edges, start, hops, stop_nodes=24, stop_types=6, max_nodes=250, priority=None):
    rank = lambda e: ((priority or {}).get(e[0], 99), e[1], e[0])
    kinds: dict[str, dict[str, list]] = {}
    for s, d, t in edges:
        if s != d:
            kinds.setdefault(s, {}).setdefault(d, []).append((t, "forward"))
            kinds.setdefault(d, {}).setdefault(s, []).append((t, "reverse"))
    seen, frontier, types = {start: 0}, {start}, set()
    for level in range(1, hops + 1):
        new = set()
        for x in frontier:
            for y, es in kinds.get(x, {}).items():
                types.add(min(es, key=rank)[0])
                if y not in seen:
                    new.add(y)
        seen |= dict.fromkeys(new, level)
        frontier = new
        if len(seen) - 1 >= max_nodes or len(seen) - 1 >= stop_nodes and len(types) >= stop_types:
            break
    return seen


def test_adaptive_neighborhood(spark, small, edges):
    """Whole levels: the registered query, and random graphs whose stops come early, late and never."""
    rows = list(edges[["src", "dst", "type"]].itertuples(index=False, name=None))
    got = catalog.QUERIES["adaptive_neighborhood"](spark, small).toPandas()
    for start, own in got.groupby("start"):
        assert dict(zip(own["node"], own["hops"], strict=True)) == _adaptive(rows, start, 3, priority=h.PRIORITY)
    assert got.groupby("start").size().min() > 100
    r = np.random.default_rng(5)
    graphs = [(f"{g}:{r.integers(40)}", f"{g}:{r.integers(40)}", f"t{r.integers(4)}") for g in range(12) for _ in range(20 + 5 * g)] + [(f"{g}:0", f"{g}:1", "t0") for g in range(12)]
    e = spark.createDataFrame([(*x, i, "s") for i, x in enumerate(graphs)], "src string, dst string, type string, key long, source string")
    seeds = spark.createDataFrame([(f"{g}:0", f"{g}:0") for g in range(12)], "start string, node string")
    out = neighborhood.adaptive_neighborhood(seeds, e, max_hops=3, stop_nodes=6, stop_types=3, max_nodes=12, priority={"t2": 0}).toPandas()
    for g in range(12):
        own = out[out["start"] == f"{g}:0"]
        assert dict(zip(own["node"], own["hops"], strict=True)) == _adaptive(graphs, f"{g}:0", 3, 6, 3, 12, {"t2": 0})


def test_converged_pagerank_of_pairs(spark, small, edges):
    """Against the exact solution; four rounds are far from it."""
    names = sorted({*edges["src"], *edges["dst"]})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    np.add.at(m, (edges["src"].map(at), edges["dst"].map(at)), 1)
    g = dense.green(m)
    g /= g.sum(axis=1, keepdims=True)
    pairs = {p["pair_id"]: (p["a"], p["b"]) for p in h.pairs(spark, small).collect()}
    whole = catalog.QUERIES["ppr_converged_pairs"](spark, small).toPandas()
    assert all(r.rank == pytest.approx(g[at[pairs[r.source_id][0]], at[r.node]], abs=1e-6) for r in whole[["source_id", "node"]].assign(rank=whole["rank"]).itertuples())
    assert set(whole["source_id"]) == set(pairs)
    told = catalog.QUERIES["explained_pairs"](spark, small).toPandas()
    assert len(told) == len(pairs) and all(p == pytest.approx(g[at[a], at[b]], abs=1e-6) for a, b, p in zip(told["a"], told["b"], told["ppr"], strict=True))
    best = catalog.QUERIES["path_rank_converged"](spark, small).toPandas()
    assert set(best["pair_id"]) == set(pairs) and all(p == pytest.approx(g[at[pairs[i][0]], at[pairs[i][1]]], abs=1e-6) for i, p in zip(best["pair_id"], best["ppr"], strict=True))


def test_node_features_converged(spark, small, edges):
    """The last feature is the exact PageRank with uniform teleport, scaled."""
    names = h.nodes(spark, small).toPandas()["node_id"].tolist()
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    np.add.at(m, (edges["src"].map(at), edges["dst"].map(at)), 1)
    x = dense.green(m).sum(axis=0)
    x /= x.sum()
    got = catalog.QUERIES["node_features"](spark, small).toPandas()
    assert len(got) == len(names)
    want = (x - x.min()) / (x.max() - x.min())
    assert all(f[-1] == pytest.approx(want[at[n]], abs=1e-4) for n, f in zip(got["node_id"], got["features"], strict=True))
    lone = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), spark.createDataFrame([(i,) for i in range(1, 5)], "node_id long")
    rank = {r["node_id"]: r["rank"] for r in pagerank.uniform_pagerank(*lone).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank[3] / rank[1] == pytest.approx(1 + 0.85 + 0.85**2, abs=1e-6)


def test_whole_texts_are_embedded():
    """Words beyond the 64th count; a prefix is taken only if asked for."""
    same = " ".join(f"w{i}" for i in range(64))
    texts = [same, f"{same} a different end", f"{same} quite another one"]
    x = models.HashedNgrams().embed(texts)
    assert x[0] @ x[1] < 0.9999 and x[1] @ x[2] < 0.9999
    y = models.HashedNgrams(most_tokens=64).embed(texts)
    assert y[0] @ y[1] == pytest.approx(1) and y[1] @ y[2] == pytest.approx(1)
    words = np.abs(models.HashedNgrams().embed([" ".join(["again"] * n) for n in (1, 500)]))
    assert words[0] == pytest.approx(words[1])


@pytest.mark.parametrize("held", [100_000, 0])
def test_lexicon_matches_of_repeated_and_unnamed_rows(spark, monkeypatch, held):
    """A held and a shuffled lexicon find the same, row by row; a long text, repeated rows, one id with two texts, null ids, null and empty texts."""
    monkeypatch.setattr(selection, "HELD_TOKENS", held)
    long = " ".join(f"word{i}" for i in range(5000)) + " alpha beta"
    rows = [(1, "alpha x beta"), (1, "alpha x beta"), (2, "beta"), (2, "gamma delta"), (None, "alpha"), (None, "alpha"), (3, long), (4, None), (5, ""), (6, "alphabet")]
    docs = spark.createDataFrame(rows, "id int, text string")
    lexicon = spark.createDataFrame([("alpha",), ("beta alpha",), ("delta",), ("nowhere",), ("word4999",), ("alpha",), ("",)], "feature string")
    got = sorted(((r["id"], r["feature"]) for r in selection.lexicon_matches(docs, lexicon, "id", "text").collect()), key=str)
    whole = lambda text, f: all(re.search(rf"\b{w}\b", text) for w in f.split())
    want = [(i, f) for i, text in rows for f in ("alpha", "beta alpha", "delta", "nowhere", "word4999") if text and whole(text, f)]
    assert got == sorted(want, key=str)
    assert selection.lexicon_matches(docs.limit(0), lexicon, "id", "text").count() == 0
    assert selection.lexicon_matches(docs, lexicon.limit(0), "id", "text").count() == 0
