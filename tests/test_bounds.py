"""Work that must not outgrow the input: searches that meet half-way, steps dealt by the rarer end, and graphs held by the part."""

import itertools
import random
from collections import deque

import pytest

from loomgraph.operators import graph, pagerank


def _graph(spark, seed, n=24, m=30):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    return rows, spark.createDataFrame(rows, "src string, dst string")


def _hops(rows, start):
    near = {}
    for s, d in rows:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


@pytest.mark.parametrize("cutoff", [0, 1, 2, 3, 4, 5])
def test_shortest_paths_meet_half_way(spark, monkeypatch, cutoff):
    rows, edges = _graph(spark, cutoff)
    ends = [(i, f"n{a}", f"n{b}") for i, (a, b) in enumerate(itertools.product(range(0, 24, 3), repeat=2))]
    want = set()
    for i, a, b in ends:
        da, db = _hops(rows, a), _hops(rows, b)
        if da.get(b, cutoff + 1) <= cutoff:
            want |= {(i, x) for x in da if x in db and da[x] + db[x] == da[b]}
    far, whole = [], graph.khop
    monkeypatch.setattr(graph, "khop", lambda seeds, edges, k, **more: far.append(k) or whole(seeds, edges, k, **more))
    got = [tuple(r) for r in graph.shortest_path_nodes(spark.createDataFrame(ends, "pair_id int, a string, b string"), edges, cutoff).collect()]
    assert set(got) == want and len(got) == len(want)
    assert max(far) <= (cutoff + 1) // 2


def test_induced_edges_follow_the_rarer_end(spark):
    """A hub with 400 edges is in all of 50 pairs: following it from its side would make 20,000 rows."""
    rows = [("hub", f"x{i}", i) if i % 2 else (f"x{i}", "hub", i) for i in range(400)] + [("x1", "x1", 400)]
    members = [(p, "hub") for p in range(50)] + [(p, f"x{p}") for p in range(50)]
    edges, m = spark.createDataFrame(rows, "src string, dst string, key int"), spark.createDataFrame(members, "pair_id int, node string")
    got = sorted(tuple(r) for r in graph.induced_edges(edges, m).collect())
    assert got == sorted((p, *e) for p in range(50) for e in rows if {e[0], e[1]} <= {"hub", f"x{p}"})


def test_pagerank_is_held_by_components(spark, monkeypatch):
    """A graph that no task can hold is solved by its components, a larger one among them by rounds, with the same ranks."""
    rows = [(f"{c}{s[1:]}", f"{c}{d[1:]}") for c in "pqr" for s, d in _graph(spark, 7, 12, 30)[0]] + [("z", "z"), ("y1", "y2")]
    big = [(f"k{s[1:]}", f"k{d[1:]}") for s, d in _graph(spark, 8, 20, 120)[0]]
    e, more = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame(rows + big, "src string, dst string")
    nodes = sorted({x for r in rows + big for x in r} | {"alone"})
    seeds = spark.createDataFrame([(i, x) for i, x in enumerate(nodes)], "source_id int, node string")
    at = spark.createDataFrame([(i, x) for i, _ in enumerate(nodes) for x in nodes[::5]], "source_id int, node string")
    every = spark.createDataFrame([(x,) for x in nodes], "node_id string")
    ask = {"settled": lambda: pagerank.personalized_pagerank(e, seeds), "rounds": lambda: pagerank.personalized_pagerank(more, seeds, rounds=3), "at": lambda: pagerank.personalized_pagerank(e, seeds, at=at), "uniform": lambda: pagerank.uniform_pagerank(e, every)}
    want = {k: {tuple(r)[:-1]: r["rank"] for r in f().collect()} for k, f in ask.items()}
    joined, whole = [], pagerank._rounds
    monkeypatch.setattr(pagerank, "HELD", 60)
    monkeypatch.setattr(pagerank, "_joined", None)  # no component is too large but in one case
    monkeypatch.setattr(pagerank, "_rounds", lambda step, *rest: joined.append({r["src"][0] for r in step.select("src").distinct().collect()}) or whole(step, *rest))
    for k, f in ask.items():
        got = {tuple(r)[:-1]: r["rank"] for r in f().collect()}
        assert got.keys() == want[k].keys() and all(got[x] == pytest.approx(want[k][x], abs=1e-12) for x in got), k
    assert joined == [{"k"}]
