"""Queries on the harness graph: keys, degrees, evidence, neighbours, distances, paths, PageRank, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import annotation, components, graph, neighborhood, pagerank, paths
from ..runtime import saved
from . import harness as h
from .registry import query


@query(f"WITH {h.EDGES_SQL} SELECT src, dst, key, type, source FROM edges")
def edge_multigraph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.edges(spark, sf_dir).select("src", "dst", "key", "type", "source")


@query(f"WITH {h.EDGES_SQL} SELECT src, dst, key, evidence FROM edges")
def edge_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.edges(spark, sf_dir).select("src", "dst", "key", "evidence")


@query(f"WITH {h.EDGES_SQL} SELECT node, degree FROM degrees")
def undirected_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected_degree(h.edges(spark, sf_dir))


@query(f"WITH {h.EDGES_SQL} SELECT a AS node, type, list_sort(list(DISTINCT b)) AS neighbors FROM both_ways GROUP BY 1, 2", name="neighbors_by_type")
def neighbors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors_by_type(h.edges(spark, sf_dir))


@query(f"""
    WITH {h.EDGES_SQL}, {h.NODES_SQL}, genes AS (SELECT * FROM nodes WHERE type = 'gene'),
    d AS (SELECT DISTINCT n.a, g.symbol FROM neighbors n JOIN genes o ON o.node_id = n.a JOIN genes g ON g.node_id = n.b),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY symbol) AS rank FROM d),
    l AS (SELECT a, string_agg(symbol, ',' ORDER BY symbol) AS genes, count(*) AS n FROM r WHERE rank <= 30 GROUP BY 1)
    SELECT node_id AS node, coalesce(genes, '') AS neighbor_genes, coalesce(n, 0)::INT AS neighbor_gene_count FROM genes LEFT JOIN l ON a = node_id
""")
def neighbor_gene_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbor_gene_cache(h.edges(spark, sf_dir), h.nodes(spark, sf_dir))


_DOMINANT = """
    typed AS (SELECT start, node, n.type FROM hop JOIN nodes n ON n.node_id = node WHERE hops > 0),
    counted AS (SELECT start, type, count(*) AS n FROM typed GROUP BY 1, 2),
    chosen AS (SELECT start, type FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, type) AS r FROM counted) WHERE r = 1)
    SELECT start, type, node, rank FROM (
        SELECT start, type, node, (row_number() OVER (PARTITION BY start ORDER BY node))::INT AS rank FROM typed JOIN chosen USING (start, type)
    ) WHERE rank <= 30
"""
_SEEDS = "seeds AS (SELECT 'supplier:' || s_suppkey AS start FROM supplier)"
_HOP2 = """
    hop1 AS (SELECT DISTINCT s.start, n.b AS node FROM seeds s JOIN neighbors n ON n.a = s.start),
    hop2 AS (SELECT DISTINCT f.start, n.b AS node FROM hop1 f JOIN neighbors n ON n.a = f.node),
    hop AS (SELECT start, node, min(hops) AS hops FROM (SELECT start, start AS node, 0 AS hops FROM seeds UNION ALL SELECT *, 1 FROM hop1 UNION ALL SELECT *, 2 FROM hop2) GROUP BY 1, 2)
"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit("supplier:"), F.col("s_suppkey"))
    return h.read(spark, sf_dir, "supplier").select(node.alias("start"), node.alias("node"))


@query(f"WITH {h.EDGES_SQL}, {_SEEDS}, {_HOP2} SELECT start, node, hops FROM hop")
def khop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.khop(_seeds(spark, sf_dir), h.edges(spark, sf_dir), 2)


@query(f"""
    WITH {h.EDGES_SQL}, {_SEEDS}, step AS (SELECT DISTINCT a, b, source FROM both_ways),
    start0 AS (SELECT DISTINCT start, source FROM seeds JOIN step ON a = start),
    hop1 AS (SELECT DISTINCT s.start, s.source, n.b AS node FROM start0 s JOIN step n ON n.a = s.start AND n.source = s.source),
    hop2 AS (SELECT DISTINCT f.start, f.source, n.b AS node FROM hop1 f JOIN step n ON n.a = f.node AND n.source = f.source),
    hop AS (SELECT start, source, node, min(hops) AS hops FROM (SELECT start, source, start AS node, 0 AS hops FROM start0 UNION ALL SELECT *, 1 FROM hop1 UNION ALL SELECT *, 2 FROM hop2) GROUP BY ALL)
    SELECT start, source, node, hops FROM hop
""")
def khop_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = h.edges(spark, sf_dir)
    there = graph.both_ways(edges.select("src", "dst", "source")).select(F.col("a").alias("node"), "source").distinct()
    seeds = _seeds(spark, sf_dir).join(there, "node").select("start", "source", "node")
    return graph.khop(seeds, edges, 2, edge_by=("source",))


@query(f"WITH {h.EDGES_SQL}, {h.NODES_SQL}, {_SEEDS}, {_HOP2}, {_DOMINANT}")
def khop_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant type among each gene's two-hop neighbours, and its first 30 of them."""
    ball = graph.khop(_seeds(spark, sf_dir), h.edges(spark, sf_dir), 2).filter("hops > 0")
    return graph.dominant_type(ball, h.nodes(spark, sf_dir), "start", 30)


@query(f"WITH {h.EDGES_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(evidence) AS best FROM edges GROUP BY 1, 2")
def best_edge_score_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_scores(h.edges(spark, sf_dir))


@query(f"""
    WITH {h.EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY evidence DESC, src, dst, key) AS r FROM edges)
    SELECT least(src, dst) AS a, greatest(src, dst) AS b, src, dst, key, type, source, evidence AS best FROM r WHERE r = 1
""")
def best_edge_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_edges(h.edges(spark, sf_dir, dealt=True), by=h.PAIR)


_RANK = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in h.PRIORITY.items()) + " ELSE 99 END"
_STEPS = f"""
    picked AS (
        SELECT a, b, type AS edge_type, source AS edge_source, CASE WHEN ways = 2 THEN 'both' ELSE direction END AS direction, key AS edge_key FROM (
            SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY {_RANK}, direction, type, key, source) AS r, (SELECT count(DISTINCT direction) FROM both_ways y WHERE y.a = x.a AND y.b = x.b) AS ways FROM both_ways x
        ) WHERE r = 1
    )
"""


@query(f"WITH {h.EDGES_SQL}, {_STEPS} SELECT a, b, edge_type, edge_source, direction, edge_key FROM picked")
def pick_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pick_steps(None, h.edges(spark, sf_dir), h.PRIORITY)


@query(f"WITH {h.EDGES_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, max({h._case('type', h.TYPE_WEIGHTS)}) AS weight FROM edges GROUP BY 1, 2")
def weighted_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weighted_undirected(h.edges(spark, sf_dir), h.TYPE_WEIGHTS)


_PATHS = """
    from_b AS (
        SELECT pair_id, node, min(dist) AS dist FROM (
            SELECT pair_id, b AS node, 0 AS dist FROM pairs
            UNION ALL SELECT pair_id, n.b, 1 FROM pairs p JOIN neighbors n ON n.a = p.b
            UNION ALL SELECT DISTINCT pair_id, m.b, 2 FROM pairs p JOIN neighbors n ON n.a = p.b JOIN neighbors m ON m.a = n.b
        ) GROUP BY 1, 2
    ),
    p1 AS (SELECT p.pair_id, p.b, n.b AS node, [p.a, n.b] AS nodes, [{'dist': d.dist, 'node': n.b}] AS steps FROM pairs p JOIN neighbors n ON n.a = p.a JOIN from_b d ON d.pair_id = p.pair_id AND d.node = n.b AND d.dist <= 2),
    p2 AS (SELECT p.pair_id, p.b, n.b AS node, list_append(p.nodes, n.b) AS nodes, list_append(p.steps, {'dist': d.dist, 'node': n.b}) AS steps FROM p1 p JOIN neighbors n ON n.a = p.node JOIN from_b d ON d.pair_id = p.pair_id AND d.node = n.b AND d.dist <= 1 WHERE p.node <> p.b AND NOT list_contains(p.nodes, n.b)),
    p3 AS (SELECT p.pair_id, p.b, n.b AS node, list_append(p.nodes, n.b) AS nodes, list_append(p.steps, {'dist': d.dist, 'node': n.b}) AS steps FROM p2 p JOIN neighbors n ON n.a = p.node JOIN from_b d ON d.pair_id = p.pair_id AND d.node = n.b AND d.dist <= 0 WHERE p.node <> p.b AND NOT list_contains(p.nodes, n.b)),
    paths AS (SELECT * FROM (SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY steps DESC))::INT AS path_no, nodes FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE node = b) WHERE path_no <= 40)
"""


@query(f"WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, {_PATHS} SELECT pair_id, path_no, nodes FROM paths")
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.bounded_paths(h.pairs(spark, sf_dir), h.edges(spark, sf_dir), 3, 40)


_ROUNDS = 4
#: Rounds after which, on the harness graph, what is left of the start alternates between suppliers and parts only; a round and alpha of the one before cancel it.
_SETTLED = 24


def _ppr_sql(rounds: int, settled: bool = False) -> str:
    parts = ["""
    steps0 AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY 1, 2), outs AS (SELECT src, count(*) AS out FROM edges GROUP BY 1),
    steps AS MATERIALIZED (SELECT src, dst, n::DOUBLE / out AS w FROM steps0 JOIN outs USING (src)), rank0 AS (SELECT pair_id, a AS seed, a AS node, 1::DOUBLE AS rank FROM pairs)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""
    rank{i} AS MATERIALIZED (
        SELECT pair_id, seed, node, sum(rank) AS rank FROM (
            SELECT pair_id, seed, coalesce(dst, seed) AS node, 0.85::DOUBLE * rank * coalesce(w, 1) AS rank FROM rank{i - 1} LEFT JOIN steps ON src = node
            UNION ALL SELECT pair_id, a, a, 1 - 0.85::DOUBLE FROM pairs
        ) GROUP BY 1, 2, 3
    )""")
    if settled:
        parts.append(f"""
    settled AS MATERIALIZED (
        SELECT pair_id, node, sum(rank) AS rank FROM (SELECT pair_id, node, rank / 1.85::DOUBLE AS rank FROM rank{rounds} UNION ALL SELECT pair_id, node, rank * 0.85::DOUBLE / 1.85::DOUBLE FROM rank{rounds - 1}) GROUP BY 1, 2
    )""")
    return ",".join(parts)


def _ppr(spark: SparkSession, sf_dir: str, edges: DataFrame, rounds: int | None = _ROUNDS, at: DataFrame | None = None) -> DataFrame:
    """Converged without a number of rounds."""
    seeds = h.pairs(spark, sf_dir).select(F.col("pair_id").alias("source_id"), F.col("a").alias("node"))
    return pagerank.personalized_pagerank(edges, seeds, rounds=rounds, at=at)


@query(f"WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, {_ppr_sql(_ROUNDS)} SELECT pair_id AS source_id, node, round(rank, 8) AS rank FROM rank{_ROUNDS}")
def ppr_fixed_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ppr(spark, sf_dir, h.edges(spark, sf_dir)).withColumn("rank", scalars.rounded(F.col("rank"), 8))


@query("""
    WITH k AS (SELECT n_nationkey AS n, any_value(n_regionkey) AS r, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1),
    x AS (SELECT *, 1 / (1 - 0.85::DOUBLE * 0.85::DOUBLE * k / (k + 1)) AS own FROM k), y AS (SELECT *, 0.85::DOUBLE * own / (k + 1) AS each FROM x)
    SELECT 'nation:' || n AS source_id, node, round(v / (own + (k + 1) * each), 9) AS rank FROM (
        SELECT *, 'nation:' || n AS node, own AS v FROM y UNION ALL SELECT *, 'region:' || r, each FROM y UNION ALL SELECT y.*, 'customer:' || c_custkey, each FROM y JOIN customer ON c_nationkey = n AND c_acctbal > 0
    )
""")
def ppr_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every nation, over customers' membership, which solvent customers return."""
    c = h.read(spark, sf_dir, "customer")
    node, nation = F.concat(F.lit("customer:"), F.col("c_custkey")), F.concat(F.lit("nation:"), F.col("c_nationkey"))
    edges = c.select(node.alias("src"), nation.alias("dst")).unionByName(c.filter("c_acctbal > 0").select(nation.alias("src"), node.alias("dst")))
    n = h.read(spark, sf_dir, "nation")
    r = n.select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("region:"), F.col("n_regionkey")).alias("dst"))
    return pagerank.personalized_pagerank(edges.unionByName(r), r.select(F.col("src").alias("source_id"), F.col("src").alias("node"))).withColumn("rank", F.round("rank", 9))


@query(f"WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, {_ppr_sql(_SETTLED, True)} SELECT pair_id AS source_id, node, round(rank, 6) AS rank FROM settled")
def ppr_converged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first end of every pair, over the harness graph."""
    return _ppr(spark, sf_dir, h.edges(spark, sf_dir), None).withColumn("rank", scalars.rounded(F.col("rank"), 6))


def _all_ranked(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    edges, pairs = h.edges(spark, sf_dir), h.pairs(spark, sf_dir)
    found = saved(paths.bounded_paths(pairs, edges, 3, 40), "ranked-paths")
    ends = pairs.select(F.col("pair_id").alias("source_id"), F.col("b").alias("node"))
    ppr = _ppr(spark, sf_dir, edges, None, ends).select(F.col("source_id").alias("pair_id"), F.col("rank").alias("ppr"))
    return paths.rank_paths(found, edges, ppr, h.PRIORITY, 3, most)


def _ranked_paths(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    return _all_ranked(spark, sf_dir, most).select("pair_id", "nodes", "sources", "switches", F.round("probability", 9).alias("probability"), F.round("ppr", 6).alias("ppr"), F.round("rank_score", 6).alias("rank_score"), "rank")


def _ranked_sql(most: int) -> str:
    return f"""
    WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, {_PATHS}, {_STEPS}, {_ppr_sql(_SETTLED, True)},
    hop AS (SELECT pair_id, path_no, i AS pos, nodes[i] AS a, nodes[i + 1] AS b FROM paths, unnest(range(1, len(nodes))) AS t(i)),
    told AS (
        SELECT pair_id, path_no, list(edge_source ORDER BY pos) AS sources, product(1::DOUBLE / degree) AS probability
        FROM hop JOIN picked USING (a, b) JOIN degrees ON node = hop.a GROUP BY 1, 2
    ),
    f AS (
        SELECT p.*, t.sources, t.probability, coalesce(r.rank, 0) AS ppr, len(nodes) - 1 AS length,
            len(list_filter(range(2, len(t.sources) + 1), lambda i: t.sources[i] <> t.sources[i - 1])) AS switches
        FROM paths p JOIN told t USING (pair_id, path_no) JOIN pairs q USING (pair_id) LEFT JOIN settled r ON r.pair_id = p.pair_id AND r.node = q.b
    ),
    s AS (
        SELECT *, 0.35::DOUBLE * (1 - greatest(0, length - 1) / 3::DOUBLE) + 0.35::DOUBLE * CASE WHEN length > 1 THEN 1 - switches::DOUBLE / (length - 1) ELSE 1 END
            + 0.2::DOUBLE * greatest(0, least(1, 1 - ln(greatest(probability, 1e-12::DOUBLE)) / ln(1e-12::DOUBLE))) + 0.1::DOUBLE * least(1, ppr) AS rank_score FROM f
    )
    SELECT pair_id, nodes, sources, switches::INT AS switches, round(probability, 9) AS probability, round(ppr, 6) AS ppr, round(rank_score, 6) AS rank_score, rank
    FROM (SELECT *, (row_number() OVER (PARTITION BY pair_id ORDER BY round(rank_score, 12) DESC, length, switches, path_no))::INT AS rank FROM s) WHERE rank <= {most}
"""


@query(_ranked_sql(4))
def path_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best paths of every pair."""
    return _ranked_paths(spark, sf_dir, 4)


@query(_ranked_sql(40))
def path_rank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths found for every pair, in order."""
    return _ranked_paths(spark, sf_dir, 40)


@query(f"""
    WITH {h.EDGES_SQL}, {h.NODES_SQL}, {_SEEDS},
    o AS (SELECT src AS start, dst AS node, max(evidence) AS score FROM edges JOIN seeds ON src = start GROUP BY 1, 2),
    t AS (SELECT o.*, coalesce(n.type = 'gene', false) AS counted FROM o LEFT JOIN nodes n ON node_id = node),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, counted ORDER BY score DESC, node) AS r FROM t) WHERE NOT counted OR r <= 5)
    SELECT start, node, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY start ORDER BY score DESC, node))::INT AS rank FROM f) WHERE rank <= 12
""")
def best_evidence_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.neighbors_by_score(_seeds(spark, sf_dir), h.edges(spark, sf_dir), h.nodes(spark, sf_dir), max_total=12, max_genes=5)


@query(f"""
    WITH {h.EDGES_SQL}, {_SEEDS}, step AS (SELECT n.a, n.b, n.e, d.degree FROM (SELECT a, b, max(evidence) AS e FROM both_ways GROUP BY 1, 2) n JOIN degrees d ON d.node = n.a),
    l1 AS (SELECT s.start, t.b AS node, t.e AS evidence, 1::DOUBLE / t.degree AS prob FROM seeds s JOIN step t ON t.a = s.start),
    c2 AS (SELECT f.start, t.b AS node, t.e AS evidence, f.prob / t.degree AS prob, f.node AS up FROM l1 f JOIN step t ON t.a = f.node
        WHERE t.b <> f.start AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.start = f.start AND x.node = t.b)),
    l2 AS (SELECT start, node, evidence, prob FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY evidence DESC, up) AS r FROM c2) WHERE r = 1),
    f AS (SELECT *, 1 AS hops FROM l1 UNION ALL SELECT *, 2 FROM l2),
    s AS (SELECT *, (0.25::DOUBLE / 0.75::DOUBLE) * (1 - (hops - 1) / 2::DOUBLE) + (0.4::DOUBLE / 0.75::DOUBLE) * evidence + (0.1::DOUBLE / 0.75::DOUBLE) * prob AS score FROM f)
    SELECT start, node, hops, evidence, round(prob, 12) AS prob, round(score, 6) AS score, rank
    FROM (SELECT *, (row_number() OVER (PARTITION BY start ORDER BY round(score, 12) DESC, hops, node))::INT AS rank FROM s) WHERE rank <= 20
""")
def ranked_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = neighborhood.ranked_khop(_seeds(spark, sf_dir), h.edges(spark, sf_dir), 2, 20)
    return best.select("start", "node", "hops", "evidence", F.round("prob", 12).alias("prob"), F.round("score", 6).alias("score"), "rank")


@query()
def ranked_khop_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best neighbours of every supplier by all five terms, PageRank and the likeness of texts (by the offline embedder) included."""
    nodes = h.nodes(spark, sf_dir)
    texts = nodes.select(F.col("node_id").alias("node"), annotation.node_text(F.col("node_id"), F.col("type"), F.create_map(F.lit("name"), F.col("symbol"))).alias("text"))
    queries = nodes.select(F.col("node_id").alias("start"), F.concat(F.lit("neighbours of "), "symbol").alias("text")).join(_seeds(spark, sf_dir).select("start"), "start", "left_semi")
    best = neighborhood.fully_ranked_khop(_seeds(spark, sf_dir), h.edges(spark, sf_dir), queries, texts, 2, 20)
    return best.select("start", "node", "hops", "evidence", *(F.round(c, 6).alias(c) for c in ("prob", "ppr", "semantic", "score")), "rank")


def _adaptive_sql(hops: int) -> str:
    parts = [f"""
    WITH {h.EDGES_SQL}, {_SEEDS}, {_STEPS}, seen0 AS (SELECT start, start AS node, 0 AS hops FROM seeds), new0 AS (SELECT start, start AS node FROM seeds), types0 AS (SELECT start, '' AS type FROM seeds WHERE false), going1 AS (SELECT start FROM seeds)"""]
    for i in range(1, hops + 1):
        parts.append(f"""
    cand{i} AS MATERIALIZED (SELECT f.start, p.b AS node, p.edge_type AS type FROM new{i - 1} f JOIN going{i} USING (start) JOIN picked p ON p.a = f.node),
    types{i} AS MATERIALIZED (SELECT start, type FROM types{i - 1} UNION SELECT start, type FROM cand{i}),
    new{i} AS MATERIALIZED (SELECT DISTINCT c.start, c.node FROM cand{i} c ANTI JOIN seen{i - 1} s ON s.start = c.start AND s.node = c.node),
    seen{i} AS MATERIALIZED (SELECT * FROM seen{i - 1} UNION ALL SELECT start, node, {i} FROM new{i}),
    going{i + 1} AS (
        SELECT start FROM (SELECT start, count(*) - 1 AS n FROM seen{i} GROUP BY 1) LEFT JOIN (SELECT start, count(*) AS t FROM types{i} GROUP BY 1) USING (start)
        WHERE n < 250 AND NOT (n >= 24 AND coalesce(t, 0) >= 6)
    )""")
    return ",".join(parts) + f" SELECT start, node, hops FROM seen{hops}"


@query(_adaptive_sql(3))
def adaptive_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.adaptive_neighborhood(_seeds(spark, sf_dir), h.edges(spark, sf_dir), max_hops=3, priority=h.PRIORITY)


@query(f"""
    WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, both_ends AS (
        SELECT p.pair_id, n.b AS node, min(1) AS d FROM pairs p JOIN neighbors n ON n.a = p.a GROUP BY 1, 2
    ), direct AS (SELECT p.pair_id FROM pairs p JOIN neighbors n ON n.a = p.a AND n.b = p.b),
    middle AS (SELECT p.pair_id, x.b AS node FROM pairs p JOIN neighbors x ON x.a = p.a JOIN neighbors y ON y.a = p.b AND y.b = x.b WHERE p.pair_id NOT IN (SELECT pair_id FROM direct)),
    joined AS (SELECT pair_id FROM middle UNION SELECT pair_id FROM direct)
    SELECT pair_id, node FROM middle UNION SELECT p.pair_id, a FROM pairs p JOIN joined USING (pair_id) UNION SELECT p.pair_id, b FROM pairs p JOIN joined USING (pair_id)
""")
def shortest_path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path_nodes(h.pairs(spark, sf_dir), h.edges(spark, sf_dir), 2)


@query(f"WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, c AS (SELECT a AS node FROM pairs UNION SELECT b FROM pairs) SELECT src, dst, key, type FROM edges WHERE src IN (SELECT node FROM c) OR dst IN (SELECT node FROM c)")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = h.pairs(spark, sf_dir)
    centers = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return graph.incident_edges(h.edges(spark, sf_dir).select("src", "dst", "key", "type"), centers)


@query(f"""
    WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, c AS (SELECT pair_id, a AS core FROM pairs UNION SELECT pair_id, b FROM pairs)
    SELECT c.pair_id AS "group", w.b AS node, max(evidence) AS best FROM both_ways w JOIN c ON c.core = w.a GROUP BY 1, 2
""")
def best_score_to_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = h.pairs(spark, sf_dir)
    cores = pairs.select(F.col("pair_id").alias("group"), F.col("a").alias("core")).unionByName(pairs.select(F.col("pair_id").alias("group"), F.col("b").alias("core")))
    return graph.best_score_to_cores(h.edges(spark, sf_dir), cores)


@query(f"""
    WITH RECURSIVE links AS (SELECT DISTINCT 'customer:' || c_custkey AS a, 'seg:' || c_mktsegment || ':' || c_nationkey AS b FROM customer),
    s AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk AS (SELECT a AS node, a AS low FROM s UNION SELECT s.b, walk.low FROM walk JOIN s ON s.a = walk.node)
    SELECT node, min(low) AS component FROM walk GROUP BY 1
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment and nation hang together."""
    c = h.read(spark, sf_dir, "customer")
    return components.connected_components(c.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("a"), F.concat_ws(":", F.lit("seg"), "c_mktsegment", "c_nationkey").alias("b")))


@query("""
    WITH c AS (SELECT DISTINCT c_custkey % 4 || ':' || c_mktsegment AS cohort, c_nationkey % 5 AS gene, c_custkey % 4 AS kind FROM customer),
    l AS (SELECT cohort, gene FROM c WHERE kind IN (0, 1) OR kind = 2 AND gene < 3), t AS (SELECT count(DISTINCT n_nationkey % 5) AS total FROM nation),
    r AS (SELECT cohort, count(DISTINCT gene) AS n FROM l GROUP BY 1)
    SELECT k.cohort FROM (SELECT DISTINCT cohort FROM c) k LEFT JOIN r USING (cohort), t WHERE n IS NULL OR n >= total
""")
def universal_hub_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of four kinds: most of the first two reach every gene, those of the third some, those of the fourth none."""
    c = h.read(spark, sf_dir, "customer").select(F.concat_ws(":", (F.col("c_custkey") % 4).cast("string"), "c_mktsegment").alias("cohort"), (F.col("c_nationkey") % 5).alias("gene"), (F.col("c_custkey") % 4).alias("kind"))
    links = c.filter("kind IN (0, 1) OR kind = 2 AND gene < 3").select("gene", "cohort")
    return graph.hub_or_isolated(links, "gene", "cohort", h.read(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("gene")), c.select("cohort"))


@query("""
    WITH l AS (SELECT DISTINCT o_orderpriority AS cohort, o_custkey AS gene FROM orders), t AS (SELECT count(DISTINCT cohort) AS total FROM l)
    SELECT gene, cohort FROM l WHERE gene IN (SELECT gene FROM l GROUP BY 1 HAVING count(DISTINCT cohort) < (SELECT total FROM t))
""")
def differential_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the priorities of their orders, without those who have every priority."""
    links = h.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderpriority").alias("cohort"))
    return graph.differential_hubs(links, "gene", "cohort")


@query()
def necessity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Necessity of the nodes of each pair's common neighbourhood."""
    edges, pairs = h.edges(spark, sf_dir), h.pairs(spark, sf_dir)
    members = graph.shortest_path_nodes(pairs, edges, 2)
    return pagerank.necessity(graph.induced_edges(edges.select("src", "dst"), members), pairs)


@query("SELECT DISTINCT upper(trim(gene_a)) AS a, upper(trim(gene_b)) AS b, least(upper(trim(gene_a)), upper(trim(gene_b))) || '/' || greatest(upper(trim(gene_a)), upper(trim(gene_b))) AS pair FROM (SELECT s_name AS gene_a, p_name AS gene_b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)")
def pair_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = h.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = li.join(h.read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(h.read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return named.select(F.upper(F.trim("s_name")).alias("a"), F.upper(F.trim("p_name")).alias("b"), scalars.pair_key(F.col("s_name"), F.col("p_name")).alias("pair")).distinct()


@query(f"""
    WITH {h.EDGES_SQL}, {_SEEDS}, l1 AS (SELECT s.start, n.b AS node, 1::DOUBLE / d.degree AS prob FROM seeds s JOIN neighbors n ON n.a = s.start JOIN degrees d ON d.node = s.start),
    l2 AS (SELECT f.start, n.b AS node, arg_min(f.prob / d.degree, f.node) AS prob FROM l1 f JOIN neighbors n ON n.a = f.node JOIN degrees d ON d.node = f.node
        WHERE n.b <> f.start AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.start = f.start AND x.node = n.b) GROUP BY 1, 2)
    SELECT start, node, round(prob, 12) AS prob FROM (SELECT start, start AS node, 1::DOUBLE AS prob FROM seeds UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)
""")
def path_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.path_probabilities(_seeds(spark, sf_dir), h.edges(spark, sf_dir), 2).withColumn("prob", F.round("prob", 12))


@query(f"WITH {h.EDGES_SQL}, {h.NODES_SQL}, {_SEEDS}, {_HOP2}, {_DOMINANT.replace('rank <= 30', 'rank <= 12')}")
def khop_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.cross_source(_seeds(spark, sf_dir), h.edges(spark, sf_dir), h.nodes(spark, sf_dir), 2)


@query(f"""
    WITH {h.EDGES_SQL}, {h.NODES_SQL}, {_SEEDS}, step AS (SELECT DISTINCT a, b, source FROM both_ways), hop AS (SELECT DISTINCT start, source, b AS node FROM seeds JOIN step ON a = start WHERE b <> start),
    typed AS (SELECT start, source, node, n.type FROM hop JOIN nodes n ON n.node_id = node), counted AS (SELECT start, source, type, count(*) AS n FROM typed GROUP BY 1, 2, 3),
    chosen AS (SELECT start, source, type FROM (SELECT *, row_number() OVER (PARTITION BY start, source ORDER BY n DESC, type) AS r FROM counted) WHERE r = 1)
    SELECT start, source, type, node, (row_number() OVER (PARTITION BY start, source ORDER BY node))::INT AS rank FROM typed JOIN chosen USING (start, source, type)
""")
def dominant_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.by_source(_seeds(spark, sf_dir), h.edges(spark, sf_dir), h.nodes(spark, sf_dir), 1)
