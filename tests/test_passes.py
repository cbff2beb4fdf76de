"""Steps over edges that are to deal and read them no oftener than they must."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.operators import graph
from loomgraph.plans import harness as h

ODD = [("x", "y", 0), ("y", "x", 0), ("y", "x", 1), ("x", "x", 0), ("x", "z", 0), (None, "y", 0), ("y", None, 0), ("y", None, 1), ("z", "w", 0)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """Loops, parallel and opposite edges, ends that are null."""
    return spark.createDataFrame(ODD, "src string, dst string, key long")


def test_best_edges_are_found_where_they_are_keyed(spark, small):
    assert plan(entry.queries()["best_edge_pair"](spark, small)).count("Exchange hashpartitioning") == 1


def test_near_nodes_are_wanted_before_they_are_gathered(spark, small):
    told = plan(entry.queries()["near_nodes"](spark, small))
    assert "LeftAnti" not in told and told.count("EndsWith") >= 2


def test_sources_are_searched_without_a_second_look_at_every_edge(spark, small):
    told = plan(entry.queries()["dominant_by_source"](spark, small))
    assert told.count("/lineitem.parquet") <= 3 and "LeftAnti" not in told


def test_messages_are_not_taken_apart(spark, small):
    assert "posexplode" not in plan(entry.queries()["relational_pass"](spark, small))


def test_neighbours_and_degrees_of_odd_edges(odd):
    both = {(a, b, k) for s, d, k in ODD for a, b in ((s, d), (d, s))}
    assert sorted(map(tuple, graph.neighbors(odd).collect())) == sorted({(a, b) for a, b, _ in both if a is not None and b is not None and a != b})
    got = {r["node"]: r["degree"] for r in graph.undirected_degree(odd).collect()}
    assert got == {n: sum(2 if a == b else 1 for a, b, _ in both if a == n) for n in {a for a, _, _ in both}}


@pytest.mark.parametrize("by", [None, ("p",)])
def test_best_edges_of_odd_edges(odd, by):
    """Ties go to the smallest src, dst, key, null first; groups by other columns are the same."""
    e = odd.select("*", F.lit(0.5).alias("evidence"), F.lit("t").alias("type"), F.lit("A").alias("source"), F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst")).alias("p"))
    got = {(r["a"], r["b"]): (r["src"], r["dst"], r["key"]) for r in graph.best_edges(e, by=by).collect()}
    assert got == {("x", "y"): ("x", "y", 0), ("x", "x"): ("x", "x", 0), ("x", "z"): ("x", "z", 0), ("y", "y"): (None, "y", 0), ("w", "z"): ("z", "w", 0)}


@pytest.mark.parametrize("cutoff", [1, 2])
def test_kept_distances_are_those_kept_afterwards(spark, odd, cutoff):
    cores = spark.createDataFrame([(1, "x"), (1, "y"), (2, "w"), (3, "none")], "pair_id long, node string")
    keep = lambda node, dist: (dist <= 0) | (node < "y")
    whole = graph.min_core_distance(cores, odd, cutoff)
    want = {tuple(r) for r in whole.filter(keep(F.col("node"), F.col("dist"))).collect()}
    assert {tuple(r) for r in graph.min_core_distance(cores, odd, cutoff, keep).collect()} == want
    assert (1, "z", 1) in {tuple(r) for r in whole.collect()} and (3, "none", 0) in want


def test_search_from_several_nodes(spark, odd):
    """A node that is a start and a neighbour is a start."""
    seeds = spark.createDataFrame([("s", "x"), ("s", "z")], "start string, node string")
    assert sorted(map(tuple, graph.khop(seeds, odd, 1).collect())) == [("s", "w", 1), ("s", "x", 0), ("s", "y", 1), ("s", "z", 0)]


def test_most_frequent_type_by_two_columns(spark):
    nodes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate("ababc")], "node_id string, type string")
    members = spark.createDataFrame([("g", s, f"n{i}") for s, some in (("A", range(5)), ("B", (1, 3, 4)), ("C", (9,))) for i in some], "start string, source string, node string")
    got = sorted(map(tuple, graph.dominant_type(members, nodes, ("start", "source")).collect()))
    assert got == [("g", "A", "a", "n0", 1), ("g", "A", "a", "n2", 2), ("g", "B", "b", "n1", 1), ("g", "B", "b", "n3", 2), ("g", "C", "unknown", "n9", 1)]


def test_keys_by_numbers_are_keys_by_names(spark, small):
    order = "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "evidence"
    for dealt in (False, True):
        e = h.edges(spark, small, dealt)
        assert graph.with_keys(e.withColumnRenamed("key", "_k"), *order).filter("key <> _k").count() == 0
