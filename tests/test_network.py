"""The relational network against one dense matrix form, its gradients against differences, training, and masking against removal."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import learning, network
from loomgraph.plans import harness as h
from loomgraph.plans import learning_queries

SHAPE = network.Shape(inputs=3, hidden=6, outputs=4, relations=3, layers=3, bases=2)


def norm(x):
    d = x - x.mean(axis=1, keepdims=True)
    return d / np.sqrt((d * d).mean(axis=1, keepdims=True) + 1e-5)


def gelu(x):
    return x * 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def forward(x, edges, w, shape, salt=0, dropout=0.0):
    """Vectors of all nodes: edges (src, dst, relation) by places."""
    h = x
    for i in range(shape.layers):
        gate = np.exp(w[f"gate{i}"]) / np.exp(w[f"gate{i}"]).sum()
        conv = h @ w[f"root{i}"]
        for s, d, r in edges:
            conv[d] = conv[d] + gate[r] * h[s] @ sum(w[f"coefficient{i}"][r, b] * w[f"basis{i}"][b] for b in range(shape.bases))
        y = norm(conv) * w[f"gain{i}"] + w[f"shift{i}"] + (h @ w[f"project{i}"] if f"project{i}" in w else h)
        h = y if i == shape.layers - 1 else gelu(y) * network.kept(np.arange(len(y)), y.shape[1], salt + i, dropout)
    return h


def logits(z, pairs, w, shape, salt=0, dropout=0.0):
    x, y = z[[p[0] for p in pairs]], z[[p[1] for p in pairs]]
    h, rows = np.concatenate((x + y, x * y, abs(x - y)), axis=1), np.array([p[0] * 1_000_003 + p[1] for p in pairs])
    for i in range(3):
        h = gelu(norm(h @ w[f"linear{i}"] + w[f"bias{i}"]) * w[f"scale{i}"] + w[f"move{i}"])
        h = h * network.kept(rows, h.shape[1], salt + 100 + i, dropout * (0.5 if i == 2 else 1))
    return (h @ w["out"])[:, 0] + w["offset"][0]


def cross_entropy(x, edges, pairs, w, shape, salt=0, dropout=0.0):
    g, y = logits(forward(x, edges, w, shape, salt, dropout), pairs, w, shape, salt, dropout), np.array([p[2] for p in pairs])
    return float((np.maximum(g, 0) - g * y + np.log1p(np.exp(-abs(g)))).mean())


@pytest.fixture(scope="module")
def tiny(spark):
    """Ten nodes over several blocks and tiles, one of them without edges, parallel edges, a loop, and edges of unknown nodes and relations."""
    r = np.random.default_rng(1)
    x = r.normal(size=(10, 3))
    edges = [(int(a), int(b), int(c)) for a, b, c in zip(r.integers(0, 9, 25), r.integers(0, 9, 25), r.integers(0, 3, 25), strict=True)] + [(1, 1, 0), (2, 3, 1), (2, 3, 1)]
    pairs = [(0, 1, 1), (1, 2, 0), (9, 3, 1), (4, 4, 0), (1, 0, 0), (1, 5, 1)]
    name = "abcdefghij"
    nodes = spark.createDataFrame([(name[i], [float(v) for v in row]) for i, row in enumerate(x)], "node_id string, features array<double>")
    told = [(name[s], name[d], f"t{k}|||s{k % 2}") for s, d, k in edges] + [("a", "zz", "t0|||s0"), ("a", "b", "other")]
    e = spark.createDataFrame(told, "src string, dst string, relation string")
    v = spark.createDataFrame([(f"t{k}|||s{k % 2}", k) for k in range(3)], "relation string, index int")
    graph = network.pack(nodes, e, v, size=4, edges_of_tile=3)
    asked = spark.createDataFrame([(name[i], name[j], y) for i, j, y in pairs] + [("a", "zz", 1)], "a string, b string, label int")
    w = network.initial(SHAPE)
    r = np.random.default_rng(7)
    return x, edges, pairs, graph, network.numbered_pairs(asked, graph).select("i", "j", "label"), {k: v + 0.1 * r.normal(size=v.shape) for k, v in w.items()}, (nodes, e, v)


def test_forward(tiny):
    x, edges, pairs, graph, asked, w, _ = tiny
    layers = network.encode(graph, w, SHAPE)
    z = np.concatenate([np.frombuffer(r["out"]).reshape(r["rows"], -1) for r in layers[-1].orderBy("block").collect()])
    assert np.abs(z - forward(x, edges, w, SHAPE)).max() < 1e-10
    got = {(r["i"], r["j"]): r["score"] for r in network.scores(graph, layers, asked, w, SHAPE).collect()}
    want = 1 / (1 + np.exp(-logits(z, pairs, w, SHAPE)))
    assert got == {(i, j): pytest.approx(p, abs=1e-10) for (i, j, _), p in zip(pairs, want, strict=True)}


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients(tiny, dropout):
    """Every weight's gradient against central differences of the dense form."""
    x, edges, pairs, graph, asked, w, _ = tiny
    loss, g = network.gradients(graph, asked, w, SHAPE, 5, dropout)
    assert loss == pytest.approx(cross_entropy(x, edges, pairs, w, SHAPE, 5, dropout), abs=1e-10)
    r, step = np.random.default_rng(3), 1e-5
    assert g.keys() == w.keys()
    for name, v in w.items():
        for at in {tuple(int(r.integers(n)) for n in v.shape) for _ in range(4)}:
            sides = []
            for sign in (1, -1):
                moved = {**w, name: v.copy()}
                moved[name][at] += sign * step
                sides.append(cross_entropy(x, edges, pairs, moved, SHAPE, 5, dropout))
            assert g[name][at] == pytest.approx((sides[0] - sides[1]) / (2 * step), abs=1e-7, rel=1e-4), (name, at)


def test_masking_is_removal(spark, tiny):
    """What a masked type or source leaves is what the graph without its edges gives."""
    x, edges, pairs, graph, _, w, _ = tiny
    name = "abcdefghij"
    positives = spark.createDataFrame([(name[i], name[j]) for i, j, _ in pairs], "a string, b string")
    got = {(r["part"], r["name"]): r["value"] for r in network.importance(graph, positives, [f"t{k}|||s{k % 2}" for k in range(3)], w, SHAPE).collect()}
    mean = lambda without: (1 / (1 + np.exp(-logits(forward(x, [e for e in edges if e[2] not in without], w, SHAPE), pairs, w, SHAPE)))).mean()
    want = {("type", f"t{k}"): mean(()) - mean((k,)) for k in range(3)} | {("source", "s0"): mean(()) - mean((0, 2)), ("source", "s1"): mean(()) - mean((1,))}
    assert got == {k: pytest.approx(v, abs=1e-10) for k, v in want.items()}


def test_optimiser():
    """Two steps against the definition, with a gradient beyond the bound."""
    w, g = {"a": np.array([1.0, -2.0])}, {"a": np.array([3.0, 4.0])}
    o = network.Optimiser(w, decay=0.1)
    m = v = np.zeros(2)
    for k in (1, 2):
        d = g["a"] / (5 + 1e-6)
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        want = w["a"] * (1 - 0.01 * 0.1) - 0.01 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w = o.step(w, g, 0.01)
        assert np.allclose(w["a"], want, atol=1e-14)
    rates = [network.rate_at(e, 10, 1.0, 2, 0.1) for e in range(10)]
    assert rates[0] == 0.01 and rates[2] == 1.0 and all(a > b for a, b in zip(rates[2:], rates[3:], strict=False)) and rates[-1] > 0.1


def test_training(spark, small):
    """Loss falls over the harness graph, with fresh negatives in every epoch, and the history is the same again."""
    history = [r.asDict() for r in learning_queries.trained_network(spark, small).orderBy("epoch").collect()]
    assert [r["epoch"] for r in history] == list(range(len(history))) and history[-1]["loss"] < history[0]["loss"]
    assert all(0 <= r["auc"] <= 1 and 0 <= r["average_precision"] <= 1 for r in history)


def test_no_pairs(spark, tiny):
    _, _, _, graph, asked, w, _ = tiny
    loss, g = network.gradients(graph, asked.limit(0), w, SHAPE)
    assert loss == 0 and all((x == 0).all() for x in g.values())
    assert network.importance(graph, spark.createDataFrame([], "a string, b string"), ["t0|||s0"], w, SHAPE).collect() == []


# -- negatives --------------------------------------------------------------------------------------------------------------------


def test_unranking(spark):
    df = spark.range(0, 50 * 49 // 2).select(F.col("id").alias("r"))
    i, j = learning.unranked(F.col("r"))
    assert [(r["i"], r["j"]) for r in df.orderBy("r").select(i.alias("i"), j.alias("j")).collect()] == [(a, b) for b in range(50) for a in range(b)]
    big = [k * (k - 1) // 2 + d for k in (10**6, 3 * 10**8, 2 * 10**9) for d in (-1, 0, 1)]
    got = spark.createDataFrame([(r,) for r in big], "r long").select("r", i.alias("i"), j.alias("j")).collect()
    assert all(0 <= x["i"] < x["j"] and x["j"] * (x["j"] - 1) // 2 + x["i"] == x["r"] for x in got)


def _far(spark, n, take, seed="42", extra=()):
    nodes = spark.createDataFrame([(f"n{i:03d}", "gene") for i in range(n)], "node_id string, type string")
    positives = spark.createDataFrame([(f"n{i:03d}", f"n{(i + 1) % n:03d}") for i in range(n)], "a string, b string")
    edges = spark.createDataFrame([("n000", f"n{i:03d}") for i in range(2, n, 2)] + list(extra), "src string, dst string")
    return [(r["a"], r["b"]) for r in learning.distant_sample(edges, nodes, positives, take, seed=seed).collect()], learning.distant_negatives(edges, nodes, positives)


def test_distant_sample(spark):
    """Distinct, allowed, of the asked size, the same again; all where fewer are left."""
    got, every = _far(spark, 12, 20)
    allowed = {(r["a"], r["b"]) for r in every.collect()}
    assert len(got) == len(set(got)) == 20 and set(got) <= allowed and got == _far(spark, 12, 20)[0]
    assert set(_far(spark, 12, 1000)[0]) == allowed and _far(spark, 12, 0)[0] == []
    assert set(got) != set(_far(spark, 12, 20, seed="43")[0])


def test_distant_sample_is_uniform(spark):
    """Chi-square of how often each allowed pair is among ten of them, over draws with many seeds at once."""
    n, free = 9, [(i, j) for j in range(9) for i in range(j) if (i + 1) % 9 != j and (j + 1) % 9 != i]
    i, j = learning.unranked(F.col("r"))
    draws = spark.range(400).select(F.col("id").alias("seed")).crossJoin(spark.range(200).select(F.col("id").alias("draw")))
    rank = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("draw"))), 1, 15), 16, 10).cast("long") % (n * (n - 1) // 2)
    rows = draws.select("seed", "draw", rank.alias("r")).groupBy("seed", "r").agg(F.min("draw").alias("draw")).select("seed", "draw", i.alias("i"), j.alias("j")).toPandas()
    rows = rows[[p in set(free) for p in zip(rows["i"], rows["j"], strict=True)]].sort_values(["seed", "draw"]).groupby("seed").head(10)
    seen = rows.groupby(["i", "j"]).size()
    want = 4000 / len(free)
    assert len(seen) == len(free) and ((seen - want) ** 2 / want).sum() < len(free) + 4 * math.sqrt(2 * len(free))


def test_negatives_grow_with_the_sample(spark):
    """Ten times the labelled nodes have a hundred times the pairs; what is drawn stays."""
    got, _ = _far(spark, 400, 30)
    assert len(set(got)) == 30


def test_negatives_query(spark, small):
    got = learning.negatives(h.edges(spark, small), h.nodes(spark, small), learning.unordered(h.pairs(spark, small)), 200)
    assert {r["kind"] for r in got.collect()} == {"hard", "distant"}


def test_a_block_is_sent_to_few_tiles(spark):
    """Each tile is sent the vectors of a whole block for every masking, so the work grows with nodes times blocks: 5,000 nodes are one block."""
    nodes = spark.range(5000).selectExpr("concat('n', id) AS node_id", "array(1.0D) AS features")
    edges = spark.range(5000).selectExpr("concat('n', id) AS src", "concat('n', (id * 7919 + 13) % 5000) AS dst", "'r' AS relation")
    packed = network.pack(nodes, edges, spark.createDataFrame([("r", 0)], "relation string, index int"))
    assert packed.tiles.count() == 1 and packed.inputs.count() == 1
