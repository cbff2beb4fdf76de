"""The tiny graph with known answers, and random graphs against brute force."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, graph, neighborhood, pagerank, paths, subgraph
from tests import dense

TINY = [("A", "P", "in_pathway", "Reactome"), ("B", "P", "in_pathway", "Reactome"), ("A", "C", "STRING", "STRING"), ("A", "C", "STRING", "STRING"), ("C", "B", "STRING", "STRING"), ("D", "A", "targets", "OT"), ("A", "B", "SL_pair", "curated"), ("B", "A", "SL_pair", "curated"), ("C", "X", "driver_in", "IntOGen"), ("E", "F", "STRING", "STRING")]


@pytest.fixture(scope="module")
def tiny(spark):
    return graph.with_keys(spark.createDataFrame([(*e, i) for i, e in enumerate(TINY)], "src string, dst string, type string, source string, seq long"), "seq")


def test_degrees(tiny):
    assert {r["node"]: r["degree"] for r in graph.undirected_degree(tiny).collect()} == {"A": 5, "B": 3, "C": 4, "P": 2, "D": 1, "X": 1, "E": 1, "F": 1}


def test_distances(spark, tiny):
    got = graph.khop(spark.createDataFrame([("A", "A")], "start string, node string"), tiny, 3)
    assert {r["node"]: r["hops"] for r in got.collect()} == {"A": 0, "B": 1, "C": 1, "D": 1, "P": 1, "X": 2}


def test_paths_and_rank(spark, tiny):
    pairs = spark.createDataFrame([(1, "A", "B"), (2, "A", "E"), (3, "A", "A")], "pair_id int, a string, b string")
    found = paths.bounded_paths(pairs, tiny, 3, 40)
    rows = {(r["pair_id"], r["path_no"]): r["nodes"] for r in found.collect()}
    assert [rows[1, i] for i in (1, 2, 3)] == [["A", "P", "B"], ["A", "C", "B"], ["A", "B"]] and rows[3, 1] == ["A"] and len(rows) == 4
    ppr = spark.createDataFrame([(1, 0.165295)], "pair_id int, ppr double")
    best = paths.rank_paths(found.filter("pair_id = 1"), tiny, ppr, {}, 3, 4)
    assert {"-".join(r["nodes"]): round(r["rank_score"], 6) for r in best.collect()} == {"A-B": 0.904880, "A-P-B": 0.783196, "A-C-B": 0.778179}


def test_pagerank(spark, tiny):
    got = {r["node"]: r["rank"] for r in pagerank.personalized_pagerank(tiny, spark.createDataFrame([(1, "A")], "source_id int, node string")).collect()}
    for n, r in {"A": 0.420463, "C": 0.178697, "B": 0.165295, "P": 0.159599, "X": 0.075946}.items():
        assert got[n] == pytest.approx(r, abs=2e-6)
    assert sum(got.values()) == pytest.approx(1) and "E" not in got


def test_necessity(spark):
    e = spark.createDataFrame([(1, "a", "x"), (1, "x", "b"), (1, "a", "y")], "pair_id int, src string, dst string")
    got = {r["node"]: r["necessity_ab"] for r in pagerank.necessity(e, spark.createDataFrame([(1, "a", "b")], "pair_id int, a string, b string")).collect()}
    assert got["x"] == pytest.approx(1) and got["y"] == 0 and got["a"] == 0


def test_hubs(spark):
    links = spark.createDataFrame([("g1", "c1"), ("g1", "c2"), ("g2", "c1")], "gene string, cohort string")
    assert [tuple(r) for r in graph.differential_hubs(links, "gene", "cohort").collect()] == [("g2", "c1")]
    genes, cohorts = links.select("gene"), spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cohort string")
    assert sorted(r[0] for r in graph.hub_or_isolated(links, "gene", "cohort", genes, cohorts).collect()) == ["c1", "c3"]


def _random(seed):
    r = random.Random(seed)
    n = r.randrange(4, 9)
    return [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(r.randrange(3, 16))]


def _search(edges, a, b, hops, limit):
    near = {}
    for s, d in edges:
        if s != d:
            near.setdefault(s, set()).add(d)
            near.setdefault(d, set()).add(s)
    dist, queue = {b: 0}, deque([b])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    out, stack = [], [[a]]
    while stack and len(out) < limit:
        p = stack.pop()
        if p[-1] == b:
            out.append(p)
            continue
        for y in sorted(near.get(p[-1], ()), key=lambda v: (dist.get(v, 99), v)):
            if y not in p and dist.get(y, 99) <= hops - len(p):
                stack.append([*p, y])
    return out


def test_paths_against_search(spark):
    graphs = [_random(s) for s in range(60)]
    edges = spark.createDataFrame([(f"{g}:{s}", f"{g}:{d}", i) for g, es in enumerate(graphs) for i, (s, d) in enumerate(es)], "src string, dst string, seq int")
    pairs = spark.createDataFrame([(g, f"{g}:n0", f"{g}:n1") for g in range(60)], "pair_id int, a string, b string")
    got = {}
    for r in paths.bounded_paths(pairs, edges, 3, 4).orderBy("pair_id", "path_no").collect():
        got.setdefault(r["pair_id"], []).append([x.split(":")[1] for x in r["nodes"]])
    for g, es in enumerate(graphs):
        assert got.get(g, []) == _search(es, "n0", "n1", 3, 4), g


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked_khop_ties(spark, tiny):
    e = tiny.withColumn("evidence", F.lit(0.5))
    got = neighborhood.ranked_khop(spark.createDataFrame([("A", "A")], "start string, node string"), e, 2, 10)
    rows = {r["node"]: r for r in got.collect()}
    assert set(rows) == {"B", "C", "D", "P", "X"} and rows["X"]["prob"] == pytest.approx(1 / 5 / 4) and rows["B"]["rank"] == 1


def test_caps(spark):
    edges = spark.createDataFrame([(1, f"d{i}", "c", 0, True, float(i), True, False) for i in range(4)], "pair_id int, src string, dst string, key int, src_is_drug boolean, src_phase double, dst_is_core boolean, src_on_path boolean")
    assert subgraph.drug_cap(edges, 2).count() == 2 and subgraph.drug_cap(edges, -1).count() == 3 and subgraph.drug_cap(edges, -1, slice_semantics=False).count() == 4
    star = spark.createDataFrame([(1, "hub", f"g{i}", 0, i / 10) for i in range(6)], "pair_id int, src string, dst string, key int, evidence double")
    facts = spark.createDataFrame([(1, n, True, False, False) for n in ["hub", *(f"g{i}" for i in range(6))]], "pair_id int, node string, is_gene boolean, core boolean, on_path boolean")
    assert sorted(r["dst"] for r in subgraph.gene_caps(star, facts, 2).collect()) == ["g4", "g5"]


def test_dense_pagerank_sums_to_one():
    m = np.array([[0, 1, 1], [0, 0, 0], [1, 0, 0]], dtype=float)
    assert dense.dense_pagerank(m, 0).sum() == pytest.approx(1)


def test_pick_steps_of_all_pairs(spark):
    """Without pairs every two joined nodes are told of, loops left out; with pairs loops and pairs without an edge too, and both ways give the same."""
    rows = [("a", "b", 0, "x", "s"), ("a", "b", 1, "w", "s"), ("b", "a", 0, "w", None), ("c", "a", 0, None, "t"), ("d", "d", 0, "x", "s"), ("b", "c", 0, "w", "u")]
    edges = spark.createDataFrame(rows, "src string, dst string, key long, type string, source string")
    told = lambda df: {(r["a"], r["b"]): (r["edge_type"], r["edge_source"], r["direction"], r["edge_key"]) for r in df.collect()}
    every = told(graph.pick_steps(None, edges, {"w": 0}))
    assert every == {
        ("a", "b"): ("w", "s", "both", 1), ("b", "a"): ("w", "unknown", "both", 0), ("a", "c"): ("related_to", "t", "reverse", 0), ("c", "a"): ("related_to", "t", "forward", 0),
        ("b", "c"): ("w", "u", "forward", 0), ("c", "b"): ("w", "u", "reverse", 0),
    }
    pairs = spark.createDataFrame([*every, ("d", "d"), ("a", "d")], "a string, b string")
    assert told(graph.pick_steps(pairs, edges, {"w": 0})) == every | {("d", "d"): ("x", "s", "both", 0), ("a", "d"): ("related_to", "unknown", "unknown", None)}


def test_first_incident(spark):
    """The first edges of a group are among the first of its nodes, a loop and an edge inside the group count once, and a hub gives its groups no more than the first."""
    rows = [("h", f"n{i:03d}", i, 1.0 - i / 1000) for i in range(100)] + [("h", "h", 0, 2.0), ("g", "h", 0, 1.5)]
    edges = spark.createDataFrame(rows, "src string, dst string, key long, evidence double")
    groups = spark.createDataFrame([(1, "h"), (1, "g"), (2, "h"), (3, "n050")], "pair_id long, node string")
    got = {}
    for r in graph.first_incident(edges, groups, 3, F.desc("evidence"), "src", "dst", "key").collect():
        got.setdefault(r["pair_id"], []).append((r["src"], r["dst"]))
    first = [("g", "h"), ("h", "h"), ("h", "n000")]
    assert {k: sorted(v) for k, v in got.items()} == {1: first, 2: first, 3: [("h", "n050")]}
