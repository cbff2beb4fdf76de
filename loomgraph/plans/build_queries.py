"""Queries of the construction steps, caches, merges and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import building, construction, graph, subgraph
from . import harness as h
from .registry import query


@query("""
    WITH r AS (SELECT o_orderpriority AS gene_a, trim(c_name) AS gene_b, o_orderkey AS seq FROM orders JOIN customer ON c_custkey = o_custkey),
    s AS (SELECT replace(gene_a, ' ', '') AS a, replace(gene_b, '#', '') AS b, seq FROM r)
    SELECT a, b, seq FROM s WHERE regexp_full_match(a, '[A-Za-z0-9][A-Za-z0-9._-]{0,31}') AND regexp_full_match(b, '[A-Za-z0-9][A-Za-z0-9._-]{0,31}') ORDER BY seq, a, b LIMIT 300
""")
def curated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = h.read(spark, sf_dir, "orders").join(h.read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    raw = o.select(F.regexp_replace("o_orderpriority", " ", "").alias("gene_a"), F.regexp_replace("c_name", "#", "").alias("gene_b"), F.col("o_orderkey").alias("seq"))
    return construction.curated_pairs(raw)


@query("""
    WITH n AS (SELECT p_brand AS symbol, p_partkey AS seq, CASE WHEN p_size < 3 THEN 'seed' WHEN p_size < 10 THEN 'curated' ELSE 'x' END AS source FROM part),
    f AS (SELECT symbol, min(seq) AS seq, arg_min(source, seq) AS source FROM n GROUP BY 1)
    SELECT symbol, (row_number() OVER (ORDER BY CASE source WHEN 'seed' THEN 0 WHEN 'curated' THEN 1 ELSE 2 END, seq, symbol))::INT AS place FROM f
""")
def prioritized_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = h.read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("seq"), F.lit("gene").alias("type"), F.when(F.col("p_size") < 3, "seed").when(F.col("p_size") < 10, "curated").otherwise("x").alias("source"))
    return construction.prioritized(n)


def _regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = h.read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("s"), "l_suppkey").alias("source_genesymbol"), F.concat(F.lit("p"), "l_partkey").alias("target_genesymbol"), F.substring(F.lit("ABCDEF "), (F.col("l_quantity") % 7 + 1).cast("int"), 1).alias("dorothea_level"),
        (F.col("l_linenumber") % 2).alias("is_stimulation"), (F.col("l_linenumber") % 3 == 0).cast("int").alias("is_inhibition"), F.col("l_returnflag").alias("sources"),
    )


_REGULATIONS = """
    reg AS (
        SELECT DISTINCT 'S' || l_suppkey AS tf, 'P' || l_partkey AS target, trim(substr('ABCDEF ', (l_quantity % 7 + 1)::INT, 1)) AS level,
            CASE WHEN l_linenumber % 2 = 1 AND l_linenumber % 3 = 0 THEN 'unknown' WHEN l_linenumber % 2 = 1 THEN 'activation' WHEN l_linenumber % 3 = 0 THEN 'inhibition' ELSE '' END AS sign, l_returnflag AS source
        FROM lineitem WHERE trim(substr('ABCDEF ', (l_quantity % 7 + 1)::INT, 1)) IN ('', 'A', 'B', 'C')
    )
"""


@query(f"WITH {_REGULATIONS} SELECT tf, target, level, sign, source FROM reg")
def regulation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = h.read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"))
    return construction.regulation_rows(_regulations(spark, sf_dir), targets).distinct()


@query(f"""
    WITH {_REGULATIONS}, u AS (SELECT DISTINCT tf, target, level, source FROM reg),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE level WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 9 END, source, tf) AS rank FROM u)
    SELECT target, tf, level, source, rank::INT AS rank FROM r WHERE rank <= 12 ORDER BY target, rank LIMIT 300
""")
def tf_topk_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = h.read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"))
    return construction.regulators_per_target(construction.regulation_rows(_regulations(spark, sf_dir), targets))


@query("""
    WITH e AS (SELECT user_id AS cell, event_type AS gene, avg(value) AS effect FROM events GROUP BY 1, 2)
    SELECT x.gene AS a, y.gene AS b, round(corr(x.effect, y.effect), 6) AS corr FROM e x JOIN e y ON x.cell = y.cell AND x.gene < y.gene GROUP BY 1, 2 HAVING abs(corr(x.effect, y.effect)) >= 0.01::DOUBLE
""")
def codependency_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = h.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).agg(F.avg("value").alias("effect"))
    return construction.codependencies(e, least=0.01).withColumn("corr", F.round("corr", 6))


@query("""
    WITH p AS (SELECT DISTINCT l_suppkey AS gene, l_partkey AS pos FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY pos) AS rank FROM p)
    SELECT gene, pos, rank::INT AS rank FROM r WHERE rank <= CASE WHEN gene % 10 = 0 THEN 10 ELSE 3 END
""")
def pathway_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = h.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("pos")).distinct()
    core = h.read(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("gene"))
    return construction.capped_pathways(rows, core)


@query("""
    WITH d AS (SELECT o_orderpriority AS tumor, o_custkey AS gene, max(o_orderkey) AS last, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2),
    t AS (SELECT n_name AS cohort, tumor, gene, last, seq FROM d JOIN (SELECT n_name, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][n_nationkey % 5 + 1] AS t FROM nation) ON t = tumor),
    r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY seq, gene) AS rank FROM t)
    SELECT cohort, gene, o_orderstatus AS role, o_totalprice::VARCHAR AS score, rank::INT AS rank FROM r JOIN orders ON o_orderkey = last AND o_custkey = gene WHERE rank <= 200
""")
def driver_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = h.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tumor"), F.col("o_custkey").alias("gene"), F.col("o_orderstatus").alias("role"), F.col("o_totalprice").cast("string").alias("score"), F.col("o_orderkey").alias("seq"))
    names = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    cohorts = h.read(spark, sf_dir, "nation").select(F.col("n_name").alias("cohort"), F.get(names, (F.col("n_nationkey") % 5).cast("int")).alias("tumor"))
    return construction.drivers(rows, cohorts)


@query("""
    SELECT c_mktsegment AS tumor, 'S' || c_custkey AS gene, c_nationkey::VARCHAR AS role, c_acctbal::VARCHAR AS score, c_custkey AS seq FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'
""")
def driver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A driver table with other names for its columns and tumours told in three ways."""
    kind = F.col("c_custkey") % 3
    tumor = F.when(kind == 0, F.concat(F.lit("TCGA-"), "c_mktsegment")).when(kind == 1, F.concat("c_mktsegment", F.lit("-US"))).otherwise(F.lower("c_mktsegment"))
    raw = h.read(spark, sf_dir, "customer").select(F.concat(F.lit(" s"), "c_custkey").alias("HGNC_Symbol"), tumor.alias("Cohort"), F.col("c_nationkey").alias("MoA"), F.col("c_acctbal").alias("QValue_combination"), F.lit("x").alias("pvalue"), F.col("c_custkey").alias("seq"))
    genes = h.read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    return construction.driver_rows(raw, genes, h.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tumor")).filter("tumor <> 'MACHINERY'"))


@query("""
    WITH r AS (SELECT l_partkey AS gene, l_orderkey * 16 + l_linenumber AS pos, l_suppkey AS drug_id, l_quantity AS phase, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 16 + l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS rank FROM lineitem)
    SELECT 'drug:' || drug_id AS src, 'gene:' || gene AS dst, phase FROM r WHERE rank <= 50
""")
def drug_target_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = h.read(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_partkey").alias("gene"), F.struct(F.col("l_orderkey") * 16 + F.col("l_linenumber"), "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"), F.col("l_suppkey").alias("drug_id"), F.col("l_quantity").alias("phase"), F.lit(None).cast("string").alias("mechanism"), F.lit(None).cast("string").alias("disease"))
    return construction.target_edges(rows).select("src", "dst", "phase")


@query("""
    WITH c AS (
        SELECT 'n:' || c_nationkey AS node_id, 0 AS step, c_custkey AS seq, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS type, c_name AS name FROM customer
        UNION ALL SELECT 'n:' || s_nationkey, 1, s_suppkey, 'supplier', s_name FROM supplier
    )
    SELECT node_id, type, name FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY type IS NULL, step, seq) AS r FROM c) WHERE r = 1
""")
def first_writer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = h.read(spark, sf_dir, "customer").select(F.concat(F.lit("n:"), "c_nationkey").alias("node_id"), F.lit(0).alias("step"), F.col("c_custkey").alias("seq"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("type"), F.col("c_name").alias("name"))
    s = h.read(spark, sf_dir, "supplier").select(F.concat(F.lit("n:"), "s_nationkey").alias("node_id"), F.lit(1).alias("step"), F.col("s_suppkey").alias("seq"), F.lit("supplier").alias("type"), F.col("s_name").alias("name"))
    return construction.merge_nodes(c.unionByName(s), ("type", "name"))


@query("""
    WITH cache AS (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size % 2 = 0), asked AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
    SELECT k, coalesce(c.v, 'fetched ' || k) AS v FROM asked LEFT JOIN cache c USING (k)
""")
def cache_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = h.read(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    asked = h.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    return construction.cache_aside(asked, cache, lambda missing: missing.withColumn("v", F.concat(F.lit("fetched "), "k")), "k")[0]


@query("""
    WITH n AS (SELECT 's:' || s_suppkey AS node_id, CASE WHEN s_acctbal > 0 THEN s_name ELSE ' ' END AS name FROM supplier), d AS (SELECT 's:' || c_custkey AS node_id, c_name AS name FROM customer)
    SELECT coalesce(n.node_id, d.node_id) AS node_id, coalesce(CASE WHEN trim(n.name) <> '' THEN n.name END, d.name, n.name) AS name FROM n FULL JOIN d ON n.node_id = d.node_id
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = h.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("node_id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(" ").alias("name"))
    d = h.read(spark, sf_dir, "customer").select(F.concat(F.lit("s:"), "c_custkey").alias("node_id"), F.col("c_name").alias("name"))
    return construction.upsert(n, d, ("name",))


_PAIR_EDGES = f"""
    {h.EDGES_SQL}, {h.PAIRS_SQL}, cores AS (SELECT pair_id, a AS core FROM pairs UNION SELECT pair_id, b FROM pairs),
    members AS (SELECT pair_id, core AS node FROM cores UNION SELECT p.pair_id, x.b FROM pairs p JOIN neighbors x ON x.a = p.a JOIN neighbors y ON y.a = p.b AND y.b = x.b),
    sub AS MATERIALIZED (
        SELECT m.pair_id, e.src, e.dst, e.key, e.type, e.evidence, e.phase, e.src = p.a OR e.src = p.b AS src_is_core, e.dst = p.a OR e.dst = p.b AS dst_is_core
        FROM members m JOIN edges e ON m.node = e.src JOIN members k ON k.node = e.dst AND k.pair_id = m.pair_id JOIN pairs p ON p.pair_id = m.pair_id
    )
"""


def _pair_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, members, pairs) of each pair's common neighbourhood."""
    edges, pairs = h.edges(spark, sf_dir), h.pairs(spark, sf_dir)
    cores = pairs.select("pair_id", F.col("a").alias("node")).unionByName(pairs.select("pair_id", F.col("b").alias("node"))).distinct().withColumn("core", F.lit(True))
    members = graph.shortest_path_nodes(pairs, edges, 2).unionByName(cores.select("pair_id", "node")).distinct().join(cores, ["pair_id", "node"], "left").fillna(False, ["core"])
    sub = graph.induced_edges(edges.select("src", "dst", "key", "type", "evidence", "phase"), members)
    core = lambda end: cores.select("pair_id", F.col("node").alias(end), F.lit(True).alias(f"{end}_is_core"))
    sub = sub.join(core("src"), ["pair_id", "src"], "left").join(core("dst"), ["pair_id", "dst"], "left").fillna(False, ["src_is_core", "dst_is_core"])
    return sub, members, pairs


@query(f"""
    WITH {_PAIR_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, src_is_core OR dst_is_core ORDER BY evidence DESC, src, dst, key) AS r, count(*) OVER (PARTITION BY pair_id, src_is_core OR dst_is_core) AS n FROM sub)
    SELECT pair_id, src, dst, key, evidence FROM r WHERE r <= floor(n * CASE WHEN src_is_core OR dst_is_core THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END)
""")
def fraction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub, _, _ = _pair_edges(spark, sf_dir)
    return subgraph.keep_fractions(sub.withColumn("touches_core", F.col("src_is_core") | F.col("dst_is_core")), near=0.5).select("pair_id", "src", "dst", "key", "evidence")


@query(f"WITH {_PAIR_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY evidence DESC, src, dst, key) AS r FROM sub) SELECT pair_id, src, dst, key, evidence FROM r WHERE r <= 20")
def trimmed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subgraph.trim_edges(_pair_edges(spark, sf_dir)[0], 20).select("pair_id", "src", "dst", "key", "evidence")


@query(f"""
    WITH {_PAIR_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, dst ORDER BY coalesce(phase, -1) DESC, src) AS r, count(*) OVER (PARTITION BY pair_id, dst) AS n FROM sub WHERE dst_is_core),
    kept AS (SELECT DISTINCT pair_id, src FROM r WHERE r <= n - 1)
    SELECT s.pair_id, s.src, s.dst, s.key FROM sub s LEFT JOIN kept k ON k.pair_id = s.pair_id AND k.src = s.src WHERE NOT starts_with(s.src, 'part:') OR k.src IS NOT NULL
""")
def capped_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub, _, _ = _pair_edges(spark, sf_dir)
    told = sub.select("pair_id", "src", "dst", "key", F.startswith("src", F.lit("part:")).alias("src_is_drug"), F.col("phase").alias("src_phase"), "dst_is_core", F.lit(False).alias("src_on_path"))
    return subgraph.drug_cap(told, -1).select("pair_id", "src", "dst", "key")


def _node_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub, members, _ = _pair_edges(spark, sf_dir)
    # A member's edges to its pair's cores are edges among the members.
    best = graph.both_ways(sub.select("src", "dst", "pair_id", "evidence")).join(members.filter("core").select("pair_id", F.col("node").alias("a")), ["pair_id", "a"]).groupBy("pair_id", F.col("b").alias("node")).agg(F.max("evidence").alias("best"))
    return members.join(best, ["pair_id", "node"], "left").fillna(0.0, ["best"]).select("pair_id", "node", "core", F.col("core").alias("protected"), F.when(F.col("core"), 0).otherwise(1).alias("dist"), F.col("best").alias("evidence"), F.round(F.length("node") / 20.0, 6).alias("ppr"), F.lit(0.0).alias("prob"))


_FACTS = f"""
    {_PAIR_EDGES}, facts AS (
        SELECT m.pair_id, m.node, m.node IN (SELECT core FROM cores c WHERE c.pair_id = m.pair_id) AS core, round(length(m.node) / 20::DOUBLE, 6) AS ppr,
            coalesce((SELECT max(w.evidence) FROM both_ways w JOIN cores c ON c.core = w.a WHERE c.pair_id = m.pair_id AND w.b = m.node), 0) AS evidence FROM members m
    )
"""


@query(f"""
    WITH {_FACTS}, s AS (SELECT *, (0.35::DOUBLE / 0.95::DOUBLE) * CASE WHEN core THEN 1 ELSE 0.5::DOUBLE END + (0.45::DOUBLE / 0.95::DOUBLE) * evidence + (0.08::DOUBLE / 0.95::DOUBLE) * ppr AS score FROM facts),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, core ORDER BY round(score, 12) DESC, node) AS r, count(*) FILTER (core) OVER (PARTITION BY pair_id) AS p FROM s)
    SELECT pair_id, node, round(score, 6) AS rank_score FROM r WHERE core OR r <= 25 - p
""")
def node_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _node_facts(spark, sf_dir).withColumn("near", F.when(F.col("core"), 1.0).otherwise(0.5))
    return subgraph.node_budget(facts, 25, {"dist": "near", "evidence": "evidence", "ppr": "ppr", "prob": "prob"}).select("pair_id", "node", F.round("rank_score", 6).alias("rank_score"))


@query(f"""
    WITH {_FACTS}, {h.NODES_SQL}
    SELECT pair_id, node, rank FROM (SELECT f.pair_id, f.node, (row_number() OVER (PARTITION BY pair_id ORDER BY core DESC, CASE WHEN core THEN 0 ELSE 1 END, CASE n.type WHEN 'gene' THEN 1 WHEN 'drug' THEN 2 ELSE 9 END, ppr DESC, node))::INT AS rank FROM facts f JOIN nodes n ON n.node_id = f.node) WHERE rank <= 15
""")
def global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _node_facts(spark, sf_dir).join(h.nodes(spark, sf_dir).select(F.col("node_id").alias("node"), "type"), "node")
    return subgraph.global_cap(facts, 15, {"gene": 1, "drug": 2, "unknown": 9}).select("pair_id", "node", "rank")


@query()
def gene_capped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub, members, _ = _pair_edges(spark, sf_dir)
    kinds = h.nodes(spark, sf_dir).select(F.col("node_id").alias("node"), (F.col("type") == "gene").alias("is_gene"))
    facts = members.join(kinds, "node").select("pair_id", "node", "is_gene", "core", F.lit(False).alias("on_path"))
    return subgraph.gene_caps(sub.select("pair_id", "src", "dst", "key", "evidence"), facts)


@query("""
    WITH p AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2)
    SELECT 'gene:' || a AS src, 'gene:' || b AS dst, 'SL_pair' AS type, 'seed' AS source, 2 * seq AS seq FROM p UNION ALL SELECT 'gene:' || b, 'gene:' || a, 'SL_pair', 'seed', 2 * seq + 1 FROM p
""")
def pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair as an edge each way."""
    li = h.read(spark, sf_dir, "lineitem")
    return construction.pair_edges(li.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).agg(F.min("l_orderkey").alias("seq")), "seed")


@query("SELECT 'gene:' || l_suppkey AS src, 'gene:' || l_partkey AS dst, 'STRING_association' AS type, 'STRING' AS source, CASE WHEN l_linenumber > 1 THEN l_discount::DOUBLE END AS score FROM lineitem")
def association_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directed edge for each row, none dropped, with scores that may be missing."""
    li = h.read(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") > 1, F.col("l_discount")))
    return construction.association_edges(li, "l_suppkey", "l_partkey", "l_discount")


@query("""
    WITH a AS (SELECT DISTINCT upper('s' || s_suppkey) AS k FROM supplier WHERE s_suppkey % 3 = 0), r AS (SELECT 's' || l_suppkey AS source, 'S' || (l_partkey % 50) AS target, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
    SELECT source, target, seq FROM r WHERE upper(source) IN (SELECT k FROM a) OR upper(target) IN (SELECT k FROM a) ORDER BY seq, source, target LIMIT 1000
""")
def interactions_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first interactions with either end among the wanted accessions."""
    li = h.read(spark, sf_dir, "lineitem")
    rows = li.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("S"), F.col("l_partkey") % 50).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    wanted = h.read(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("accession"))
    return construction.interactions_in_scope(rows, wanted, 1000)


@query(f"""
    WITH {h.EDGES_SQL}, {h.PAIRS_SQL}, c AS (SELECT pair_id, a AS node FROM pairs UNION SELECT pair_id, b FROM pairs), n AS (SELECT DISTINCT c.pair_id, m.b AS node FROM c JOIN neighbors m ON m.a = c.node),
    f AS (SELECT pair_id, node, 1 AS dist, node LIKE '%7' AS protected FROM n UNION SELECT pair_id, node, 0, true FROM c)
    SELECT pair_id, node, min(dist) AS dist FROM f WHERE dist <= 0 OR protected GROUP BY 1, 2
""")
def near_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes near the cores that are within the limit or protected."""
    pairs = h.pairs(spark, sf_dir)
    cores = pairs.select("pair_id", F.col("a").alias("node")).unionByName(pairs.select("pair_id", F.col("b").alias("node")))
    guarded = lambda node, dist: (dist <= 0) | node.like("%7")
    facts = graph.min_core_distance(cores, h.edges(spark, sf_dir), 1, guarded).withColumn("protected", guarded(F.col("node"), F.col("dist")))
    return subgraph.near_nodes(facts, 0).select("pair_id", "node", "dist")


def sources(spark: SparkSession, sf_dir: str) -> building.Sources:
    """The driver's tables, whole, as the sources of a build: suppliers and parts as genes, line items as associations, interactions, regulations, effects, pathways and drugs, nations as cohorts, customers as their drivers."""
    read = lambda t: h.read(spark, sf_dir, t)
    gene = lambda n, c: F.concat(F.lit(n), F.col(c).cast("string"))
    s, li, nation = read("supplier"), read("lineitem").withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber")), read("nation")
    key, supplier, part = F.col("s_suppkey"), gene("S", "l_suppkey"), gene("G", "l_partkey")
    after = lambda n: F.concat(F.lit("S"), (key + n).cast("string"))
    accession = lambda letter, c: F.format_string(f"{letter}%05d", F.col(c))
    seeds = s.select(after(0).alias("a"), after(1).alias("b"), key.alias("seq"))
    curated = s.select(after(1).alias("a"), F.when(key % 4 == 0, "").otherwise(after(3)).alias("b"), key.alias("seq"), F.when(key % 2 == 0, "tissue").alias("context"), F.lit(None).cast("string").alias("note"))
    associations = li.select(supplier.alias("a"), part.alias("b"), F.when(F.col("l_tax") > 0.02, F.col("l_discount")).alias("score"), "seq")
    accessions = s.select(after(0).alias("gene"), accession("P", "s_suppkey").alias("accession"))
    interactions = li.select(accession("P", "l_suppkey").alias("source"), accession("Q", "l_partkey").alias("target"), "seq")
    regulations = li.select(F.when(F.col("l_orderkey") % 3 == 0, F.lower(accession("P", "l_suppkey"))).otherwise(supplier).alias("tf"), F.lower(part).alias("target"), F.substring(F.lit("ABCDEX"), (F.col("l_quantity") % 6 + 1).cast("int"), 1).alias("level"), F.when(F.col("l_tax") > 0.04, "activation").alias("sign"), F.col("l_returnflag").alias("source"))
    effects = li.groupBy(F.concat_ws("-", "l_linenumber", "l_returnflag", "l_linestatus").alias("cell"), supplier.alias("gene")).agg(F.max("l_extendedprice").cast("double").alias("effect"))
    both = li.select(supplier.alias("s"), part.alias("p"), "l_suppkey", "l_partkey").distinct()
    pathway = lambda own, other, pos: both.select(F.col(own).alias("gene"), F.col(pos).alias("pos"), F.col(other).alias("pathway_id"), F.concat(F.lit("pathway of "), other).alias("name"))
    pathways = pathway("s", "p", "l_partkey").unionByName(pathway("p", "s", "l_suppkey"))
    cohorts = nation.select(F.col("n_name").alias("cohort"), gene("T", "n_regionkey").alias("tumor"))
    drivers = read("customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(gene("T", "n_regionkey").alias("tumor"), gene("G", "c_custkey").alias("gene"), F.col("c_mktsegment").alias("role"), F.lit(0.1).alias("score"), F.col("c_custkey").alias("seq"))
    drugs = li.select(supplier.alias("gene"), F.col("seq").alias("pos"), gene("D", "l_partkey").alias("drug_id"), (F.col("l_quantity") % 5).cast("int").alias("phase"), F.col("l_returnflag").alias("mechanism"), F.col("l_linestatus").alias("disease"))
    return building.Sources(seeds, curated, associations, accessions, interactions, regulations, effects, pathways, cohorts, drivers, drugs, not_genes=("S5",), caps={"tf_per_target": 3, "interactions": 200, "drug_rows": 4})


@query()
def built_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a whole build."""
    return building.build(sources(spark, sf_dir)).nodes


@query()
def built_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a whole build."""
    return building.build(sources(spark, sf_dir)).edges
