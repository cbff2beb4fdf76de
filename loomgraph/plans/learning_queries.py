"""Queries of the learning-side data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning, network, pagerank, relational, subgraph
from ..operators.ordering import running_sums
from ..runtime import saved
from . import harness as h
from .registry import query


@query(f"WITH {h.EDGES_SQL} SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS index FROM (SELECT DISTINCT type || '|||' || source AS relation FROM edges)")
def relation_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.relation_vocab(h.edges(spark, sf_dir))


@query(f"""
    WITH {h.EDGES_SQL}, e AS (SELECT src AS node, type FROM edges UNION ALL SELECT dst, type FROM edges), n AS (SELECT node, type, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT node, type, n, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY type)), 6) AS scaled FROM n
""")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.relation_counts(h.edges(spark, sf_dir)).withColumn("scaled", F.round("scaled", 6))


@query(f"""
    WITH {h.EDGES_SQL}, {h.NODES_SQL}, d AS (SELECT node_id, ln(1 + coalesce(degree, 0)) AS x FROM nodes LEFT JOIN degrees ON node = node_id)
    SELECT node_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER () + 1e-9::DOUBLE), 6) AS log_degree FROM d
""")
def log_degree_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.scaled_log_degree(h.edges(spark, sf_dir), h.nodes(spark, sf_dir)).withColumn("log_degree", F.round("log_degree", 6))


#: Rounds after which, on the harness graph, what is left of the start alternates between suppliers and parts only; a round and alpha of the one before cancel it.
_SETTLED = 24


def _pagerank_sql(rounds: int) -> str:
    parts = [f"""{h.EDGES_SQL}, {h.NODES_SQL}, outs AS (SELECT src, count(*) AS out FROM edges GROUP BY 1),
    steps AS MATERIALIZED (SELECT e.src, e.dst, count(*)::DOUBLE / any_value(out) AS w FROM edges e JOIN outs USING (src) GROUP BY 1, 2), size AS (SELECT count(*)::DOUBLE AS n FROM nodes),
    r0 AS (SELECT node_id, 1 / n AS rank FROM nodes, size)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""
    s{i} AS MATERIALIZED (SELECT dst AS node_id, sum(rank * coalesce(w, 1)) AS got FROM r{i - 1} LEFT JOIN steps ON src = node_id GROUP BY 1),
    r{i} AS MATERIALIZED (SELECT nodes.node_id, 0.85::DOUBLE * (coalesce(s.got, 0) + coalesce((SELECT sum(got) FROM s{i} WHERE node_id IS NULL), 0) / n) + (1 - 0.85::DOUBLE) / n AS rank FROM nodes LEFT JOIN s{i} s ON s.node_id = nodes.node_id, size)""")
    return ",".join(parts) + f""",
    settled AS MATERIALIZED (SELECT node_id, (a.rank + 0.85::DOUBLE * b.rank) / 1.85::DOUBLE AS rank FROM r{rounds} a JOIN r{rounds - 1} b USING (node_id))"""


@query(f"WITH {_pagerank_sql(_SETTLED)} SELECT node_id, round(rank, 9) AS rank FROM settled")
def pagerank_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.uniform_pagerank(h.edges(spark, sf_dir), h.nodes(spark, sf_dir)).withColumn("rank", F.round("rank", 9))


_KINDS = ["drug", "gene", "pathway"]
_SPREAD = "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER () + 1e-9::DOUBLE)"


#: Rounds that leave 0.85 to their power, below 1e-14, of the start on any graph.
_ANY = 200
#: The ranks of any graph: rank that dangles is left out and made up for in the end, which takes as long to settle as the slowest part of the graph. Nodes are numbers in the rounds.
_SETTLED_SQL = f"""{h.EDGES_SQL}, {h.NODES_SQL}, ids AS MATERIALIZED (SELECT node_id, row_number() OVER () AS i, count(*) OVER () AS n FROM (SELECT DISTINCT node_id FROM nodes)),
    outs AS (SELECT src, count(*) AS out FROM edges GROUP BY 1),
    steps AS MATERIALIZED (SELECT a.i AS f, b.i AS t, 0.85::DOUBLE * count(*) / any_value(out) AS w FROM edges e JOIN outs USING (src) JOIN ids a ON a.node_id = e.src JOIN ids b ON b.node_id = e.dst GROUP BY 1, 2),
    rounds(i, rank, done) USING KEY (i) AS (
        SELECT i, 1 / n::DOUBLE AS rank, 0 AS done FROM ids
        UNION SELECT i, sum(rank), any_value(done) + 1 FROM (SELECT t AS i, rank * w AS rank, done FROM rounds JOIN steps ON f = rounds.i WHERE done < {_ANY} UNION ALL SELECT i, 1 / n::DOUBLE, (SELECT any_value(done) FROM rounds) FROM ids WHERE (SELECT any_value(done) FROM rounds) < {_ANY}) GROUP BY i
    ), settled AS MATERIALIZED (SELECT node_id, rank / sum(rank) OVER () AS rank FROM rounds JOIN ids USING (i) WHERE done = {_ANY})"""


@query(f"""
    WITH RECURSIVE {_SETTLED_SQL}, e AS (SELECT src AS node, type FROM edges UNION ALL SELECT dst, type FROM edges), n AS (SELECT node, type, count(*) AS n FROM e GROUP BY 1, 2),
    c AS (SELECT node, type, ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY type)) AS scaled FROM n), l AS (SELECT node, map(list(type), list(scaled)) AS m FROM c GROUP BY 1),
    d AS (SELECT node_id, {_SPREAD} AS v FROM (SELECT node_id, ln(1 + coalesce(degree, 0)) AS x FROM nodes LEFT JOIN degrees ON node = node_id)), p AS (SELECT node_id, {_SPREAD} AS v FROM (SELECT node_id, rank AS x FROM settled))
    SELECT node_id, list_transform([{", ".join(f"(type = '{k}')::INT::DOUBLE" for k in _KINDS)}, d.v, {", ".join(f"coalesce(m['{t}'], 0)::DOUBLE" for t in h.TYPES)}, p.v], lambda x: round(x, 6)) AS features
    FROM nodes JOIN d USING (node_id) JOIN p USING (node_id) LEFT JOIN l ON l.node = node_id
""")
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = h.nodes(spark, sf_dir), h.edges(spark, sf_dir)
    made = learning.node_features(nodes, edges, _KINDS, h.TYPES, pagerank.uniform_pagerank(edges, nodes))
    return made.withColumn("features", F.transform("features", lambda x: F.round(x, 6)))


_POSITIVE = "positives AS (SELECT least('supplier:' || x.s_suppkey, 'supplier:' || y.s_suppkey) AS a, greatest('supplier:' || x.s_suppkey, 'supplier:' || y.s_suppkey) AS b FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1)"


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.unordered(h.pairs(spark, sf_dir))


_HARD = """
    hard AS (
        SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges JOIN nodes x ON x.node_id = src AND x.type = 'gene' JOIN nodes y ON y.node_id = dst AND y.type = 'gene' WHERE src <> dst
        EXCEPT SELECT a, b FROM positives
    )
"""
_DISTANT = """
    known AS (SELECT a AS n FROM positives UNION SELECT b FROM positives),
    far AS (SELECT x.n AS a, y.n AS b FROM known x JOIN known y ON x.n < y.n EXCEPT SELECT a, b FROM positives EXCEPT SELECT a, b FROM hard)
"""


@query(f"WITH {h.EDGES_SQL}, {h.NODES_SQL}, {_POSITIVE}, {_HARD} SELECT a, b FROM hard")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.hard_negatives(h.edges(spark, sf_dir), h.nodes(spark, sf_dir), _positives(spark, sf_dir))


@query(f"WITH {h.EDGES_SQL}, {h.NODES_SQL}, {_POSITIVE}, {_HARD}, {_DISTANT} SELECT a, b FROM far")
def distant_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.distant_negatives(h.edges(spark, sf_dir), h.nodes(spark, sf_dir), _positives(spark, sf_dir))


@query(f"""
    WITH {h.EDGES_SQL}, {h.NODES_SQL}, {_POSITIVE}, {_HARD}, {_DISTANT}, k AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS size FROM known),
    d AS (SELECT draw, ('0x' || substr(md5('42|' || draw), 1, 15))::BIGINT % (SELECT max(size * (size - 1) // 2) FROM k) AS r FROM range(20000) t(draw)),
    u AS (SELECT min(draw) AS draw, r FROM d GROUP BY r), j AS (SELECT draw, r, x.n AS b, x.i * (x.i - 1) // 2 AS below FROM u JOIN k x ON r >= x.i * (x.i - 1) // 2 AND r < (x.i + 1) * x.i // 2),
    p AS (SELECT draw, x.n AS a, j.b FROM j JOIN k x ON x.i = r - below)
    SELECT a, b, 'hard' AS kind FROM (SELECT * FROM hard ORDER BY md5('42|' || a || '|' || b), a, b LIMIT 140)
    UNION ALL SELECT a, b, 'distant' FROM (SELECT p.* FROM p SEMI JOIN far USING (a, b) ORDER BY draw LIMIT 60)
""")
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.negatives(h.edges(spark, sf_dir), h.nodes(spark, sf_dir), _positives(spark, sf_dir), 200)


@query(f"WITH {_POSITIVE}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || a || '|' || b), a, b) AS r, count(*) OVER () AS n FROM positives) SELECT a, b, CASE WHEN r <= greatest(10, floor(0.15::DOUBLE * n)) THEN 'validation' ELSE 'train' END AS part FROM r")
def train_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.train_validation(_positives(spark, sf_dir))


@query("""
    WITH v AS (SELECT p_type AS name, avg(p_retailprice) AS value FROM part GROUP BY 1), c AS (SELECT name, (value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-12::DOUBLE) AS z FROM v)
    SELECT name, round(0.01::DOUBLE + 0.99::DOUBLE / (1 + exp(-2 * z)), 4) AS weight FROM c
""")
def weight_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = h.read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.avg("p_retailprice").alias("value"))
    return learning.calibrated(raw).select("name", "weight")


@query("""
    WITH v AS (SELECT p_type AS name, avg(p_retailprice) AS a, greatest(0, avg(p_size) - 25) AS d FROM part GROUP BY 1),
    c AS (SELECT name, round(0.01::DOUBLE + 0.99::DOUBLE / (1 + exp(-2 * (a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-12::DOUBLE))), 4) AS x, round(0.01::DOUBLE + 0.99::DOUBLE / (1 + exp(-2 * (d - avg(d) OVER ()) / (stddev_pop(d) OVER () + 1e-12::DOUBLE))), 4) AS y FROM v),
    w AS (SELECT name, round(0.7::DOUBLE * x + (1 - 0.7::DOUBLE) * y, 4) AS weight FROM c)
    SELECT name, weight, row_number() OVER (ORDER BY weight DESC, name) - 1 AS priority FROM w UNION ALL SELECT 'SL_pair', 1.0::DOUBLE, (SELECT count(*) FROM w)
""")
def blended_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = h.read(spark, sf_dir, "part")
    attention = p.groupBy(F.col("p_type").alias("name")).agg(F.avg("p_retailprice").alias("value"))
    drop = p.groupBy(F.col("p_type").alias("name")).agg((F.avg("p_size") - 25).alias("value"))
    return learning.blended_weights(attention, drop, fixed={"SL_pair": 1.0})


@query("""
    WITH g AS (SELECT n_chars AS score, sum(quality) AS p, sum(1 - quality) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT round(sum(n * (tp - p / 2::DOUBLE)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 6) AS average_precision FROM c
""")
def auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = h.read(spark, sf_dir, "documents").join(h.read(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))
    return learning.auc(rows).select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH {h.EDGES_SQL} SELECT type, round(avg(evidence), 6) AS value FROM edges GROUP BY 1")
def relation_type_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = h.edges(spark, sf_dir).select(F.concat_ws(learning.SEPARATOR, "type", "source").alias("relation"), F.col("evidence").alias("value"))
    return learning.averages_by_half(scores)[0].withColumn("value", F.round("value", 6))


@query("""
    WITH b AS (SELECT l_orderkey AS item, sum(l_quantity) AS score FROM lineitem GROUP BY 1), n AS (SELECT DISTINCT l_returnflag AS name FROM lineitem),
    m AS (SELECT name, item, score - coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = item AND l_returnflag = name), 0) AS masked, score FROM b, n)
    SELECT name, round(avg(score - masked), 6) AS value FROM m GROUP BY 1
""")
def counterfactual_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' quantities with the lines of each return flag masked."""
    li = h.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), "l_returnflag", "l_quantity")
    base = li.groupBy("item").agg(F.sum("l_quantity").alias("score"))
    own = li.groupBy("item", F.col("l_returnflag").alias("name")).agg(F.sum("l_quantity").alias("own"))
    names = li.select(F.col("l_returnflag").alias("name")).distinct()
    masked = base.join(F.broadcast(names)).join(own, ["item", "name"], "left").select("name", "item", (F.col("score") - F.coalesce("own", F.lit(0.0))).alias("score"))
    return learning.counterfactual_drops(base, masked).withColumn("value", F.round("value", 6))


@query("SELECT type, (row_number() OVER (ORDER BY m DESC, type))::INT AS rank FROM (SELECT p_type AS type, round(avg(p_retailprice), 9) AS m FROM part GROUP BY 1)")
def node_type_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.type_ranks(h.read(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_retailprice").alias("norm")))


@query(f"""
    WITH {h.EDGES_SQL}, e AS (SELECT *, CASE WHEN type = 'targets' THEN 'SL_pair' ELSE type END AS kind, CASE source WHEN 'A' THEN 'curated' ELSE source END AS origin FROM edges)
    SELECT src, dst, key, CASE WHEN kind = 'SL_pair' THEN 'label' ELSE 'message' END AS part FROM e WHERE kind <> 'SL_pair' OR origin = 'curated'
""")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message edges and labels; uncurated label relations are neither."""
    e = h.edges(spark, sf_dir).select("src", "dst", "key", F.when(F.col("type") == "targets", "SL_pair").otherwise(F.col("type")).alias("type"), F.when(F.col("source") == "A", "curated").otherwise(F.col("source")).alias("source"))
    message, label = learning.split_labels(e)
    learning.assert_no_leak(message)
    return message.select("src", "dst", "key", F.lit("message").alias("part")).unionByName(label.select("src", "dst", "key", F.lit("label").alias("part")))


@query(f"""
    WITH {h.EDGES_SQL}, {h.NODES_SQL}, n AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS index FROM nodes),
    v AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS index FROM (SELECT DISTINCT type || '|||' || source AS relation FROM edges))
    SELECT a.index AS src_index, b.index AS dst_index, v.index AS relation_index FROM edges e JOIN n a ON a.node_id = e.src JOIN n b ON b.node_id = e.dst JOIN v ON v.relation = e.type || '|||' || e.source
""")
def edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered nodes and relations of every edge."""
    edges = h.edges(spark, sf_dir)
    numbered = running_sums(h.nodes(spark, sf_dir).select("node_id"), [F.col("node_id")], index=F.lit(1)).select("node_id", (F.col("index") - 1).alias("index"))
    return learning.edge_index(edges, numbered, learning.relation_vocab(edges))


@query(f"""
    WITH {h.EDGES_SQL}, t AS (SELECT type, avg(evidence) AS type_attn, max(evidence) AS type_drop FROM edges GROUP BY 1), s AS (SELECT source, avg(evidence) AS src_attn, min(evidence) AS src_drop FROM edges GROUP BY 1)
    SELECT src, dst, key, round(type_attn, 9) AS type_attn, type_drop, round(src_attn, 9) AS src_attn, src_drop FROM edges JOIN t USING (type) JOIN s USING (source)
""")
def annotated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the scores of their type and source."""
    e = h.edges(spark, sf_dir).select("src", "dst", "key", "type", "source", "evidence")
    types = e.groupBy("type").agg(F.round(F.avg("evidence"), 9).alias("type_attn"), F.max("evidence").alias("type_drop"))
    origins = e.groupBy("source").agg(F.round(F.avg("evidence"), 9).alias("src_attn"), F.min("evidence").alias("src_drop"))
    return subgraph.annotate(e, types, origins).select("src", "dst", "key", "type_attn", "type_drop", "src_attn", "src_drop")


@query()
def relational_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer of message passing over the harness graph, from each node's scaled log degree and type, with weights that follow from their places."""
    edges, nodes = h.edges(spark, sf_dir), h.nodes(spark, sf_dir)
    features = learning.scaled_log_degree(edges, nodes).join(nodes.select("node_id", "type"), "node_id").select("node_id", F.array(F.col("log_degree"), *(F.when(F.col("type") == k, 1.0).otherwise(0.0) for k in ("gene", "drug", "pathway"))).alias("features"))
    return relational.apply_layer(features, edges.select("src", "dst", F.col("type").alias("relation")), example_layer()).select("node_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def example_layer() -> relational.Layer:
    """Small weights that anyone can write down: waves over the places of the arrays."""
    wave = lambda *shape: np.sin(1.0 + np.arange(int(np.prod(shape)))).reshape(shape)
    n = len(h.TYPES)
    return relational.Layer(tuple(h.TYPES), wave(2, 4, 4), wave(n, 2), wave(n), wave(4, 4), wave(4), np.ones(4), np.zeros(4))


def _labelled_graph(spark: SparkSession, sf_dir: str) -> tuple[network.Graph, DataFrame, DataFrame, DataFrame, network.Shape, list[str]]:
    """(packed graph, message edges, nodes, positive pairs, shape, relations) of the harness graph: its target edges between genes are the labels and pass no messages; features are types, scaled degree, scaled counts and scaled PageRank."""
    every, nodes = h.edges(spark, sf_dir).select("src", "dst", "key", "type", "source"), saved(h.nodes(spark, sf_dir), "labelled-nodes")
    edges = saved(every.filter("type <> 'targets'"), "labelled-edges")
    genes = nodes.filter("type = 'gene'").select("node_id")
    labels = every.filter("type = 'targets'").join(genes.withColumnRenamed("node_id", "src"), "src", "left_semi").join(genes.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    features = learning.node_features(nodes, edges, _KINDS, h.TYPES, pagerank.uniform_pagerank(edges, nodes))
    vocab = learning.relation_vocab(edges)
    relations = [r["relation"] for r in vocab.orderBy("index").collect()]  # types times sources
    graph = network.pack(features, edges.select("src", "dst", F.concat_ws(learning.SEPARATOR, "type", "source").alias("relation")), vocab)
    return graph, edges, nodes, saved(learning.unordered(labels, "src", "dst"), "labelled-pairs"), network.Shape(len(_KINDS) + len(h.TYPES) + 2, 16, 8, len(relations), layers=2, bases=4, dropout=0.1), relations


@query()
def trained_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of a few epochs over the harness graph, with fresh negatives in every epoch, and AUC and average precision on held-out pairs."""
    graph, edges, nodes, pairs, shape, _ = _labelled_graph(spark, sf_dir)
    split = saved(learning.train_validation(pairs), "labelled-split")
    positives, held = split.filter("part = 'train'").select("a", "b"), split.filter("part = 'validation'").select("a", "b")
    far = learning.negatives(edges, nodes, pairs, held.count() * learning.VALIDATION_NEGATIVES, seed="validation")
    validation = held.withColumn("label", F.lit(1)).unionByName(far.select("a", "b", F.lit(0).alias("label")))
    _, history = network.train(graph, edges, nodes, positives, validation, shape, epochs=4, rate=0.02)
    return spark.createDataFrame([tuple(x.values()) for x in history], "epoch int, loss double, auc double, average_precision double, rate double")


@query()
def relation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the probability of the labelled pairs falls without each type and each source, with the weights that training starts from."""
    graph, _, _, pairs, shape, relations = _labelled_graph(spark, sf_dir)
    return network.importance(graph, pairs, relations, network.initial(shape), shape)
