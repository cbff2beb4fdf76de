"""Walks followed block by block against the same by joins."""

import random

import pytest

from loomgraph.operators import graph, neighborhood, walks


def _tables(spark):
    rng = random.Random(5)
    rows = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", f"s{rng.randrange(2)}"): rng.choice([0.25, 0.5, 0.75, None]) for _ in range(160)}
    steps = spark.createDataFrame([(a, b, s, e, 1 + len(a)) for (a, b, s), e in rows.items()], "a string, b string, source string, e double, degree int")
    front = spark.createDataFrame(list({(f"x{rng.randrange(6)}", f"s{rng.randrange(2)}", f"n{rng.randrange(40)}", 0.5 + rng.randrange(3)) for _ in range(60)}), "start string, source string, node string, prob double").dropDuplicates(["start", "source", "node"])
    return steps, front, front.select("start", "source", (graph.F.concat(graph.F.lit("n"), (graph.F.length("node") * 7).cast("string"))).alias("node")).distinct()


@pytest.mark.parametrize("kind", ["reached", "unfiltered", "first", "best"])
@pytest.mark.parametrize("wide", [0, 20, 1 << 40])
def test_blocks_follow_as_joins_do(spark, monkeypatch, kind, wide):
    """Few walks to a block, two neighbours to a list, and starts with more than wide walks by joins."""
    steps, front, seen = _tables(spark)
    if kind in ("reached", "unfiltered"):
        steps, front = steps.select("a", "b", "source").distinct(), front.drop("prob")
    score = "e" if kind == "best" else None
    if kind == "best":
        steps = steps.groupBy("a", "b", "source").agg(graph.F.max("e").alias("e"), graph.F.first("degree").alias("degree"))
    seen = None if kind == "unfiltered" else seen
    ask = {"by": ("start",), "edge_by": ("source",)}
    want = walks._joined(front, steps, seen, score=score, **ask).collect()
    monkeypatch.setattr(walks, "WALKS", 30)
    monkeypatch.setattr(walks, "LIST", 2)
    monkeypatch.setattr(walks, "WIDE", wide)
    if wide > 1000:
        monkeypatch.setattr(walks, "_joined", None)
    got = walks.followed(front, steps, seen, score=score, **ask)
    assert got.columns[:3] == ["start", "source", "node"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in want))) and want


def test_walks_go_by_blocks(spark):
    """60 starts, 60 nodes between and 60 ends, all linked: 216,000 walks, which joins would make rows of."""
    edges = spark.createDataFrame([(f"a{i}", f"b{j}", 0, 0.5) for i in range(60) for j in range(60)], "src string, dst string, key int, evidence double")
    seeds = spark.createDataFrame([(f"a{i}", f"a{i}") for i in range(60)], "start string, node string")
    for ask in (lambda: graph.khop(seeds, edges, 2), lambda: neighborhood.reached_khop(seeds, edges, 2), lambda: neighborhood.path_probabilities(seeds, edges, 2)):
        found = ask()
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() >= 7140 and "MapInArrow" in plan
