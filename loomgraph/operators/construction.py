"""Steps that build the graph from sources: each turns tables into contributions of nodes and edges, which are merged once.

Order is data: seq numbers what comes first wherever the first or last writer wins or a cap counts in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import graph, tiles

#: Caps of the shipped configuration.
CURATED, CORE_PAIRS, TF_PER_TARGET, TF_EDGES, CODEPENDENCIES, LEAST_CORRELATION, DRIVERS, DRUG_ROWS = 300, 30, 12, 300, 30, 0.15, 200, 50
LEVELS = ("A", "B", "C")
FIRST = {"tf": ("source_genesymbol", "tf", "source"), "target": ("target_genesymbol", "target"), "level": ("dorothea_level", "level", "confidence"), "sign": ("sign", "effect", "consensus_direction", "direction"), "origin": ("sources", "source_db", "resource")}


def first_of(df: DataFrame, names: tuple[str, ...], default: str = "") -> Column:
    """The first non-blank of those columns that the table has."""
    have = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in names if c in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


def curated_pairs(raw: DataFrame, limit: int = CURATED, a: str = "gene_a", b: str = "gene_b", seq: str = "seq") -> DataFrame:
    """(a, b, seq) of the pairs whose symbols are both well formed, the first limit of them."""
    clean = raw.select(scalars.clean_symbol(F.col(a)).alias("a"), scalars.clean_symbol(F.col(b)).alias("b"), F.col(seq).alias("seq")).filter("a IS NOT NULL AND b IS NOT NULL")
    return clean.orderBy("seq", "a", "b").limit(limit)


def prioritized(nodes: DataFrame, kind: str = "gene") -> DataFrame:
    """(symbol, place): distinct symbols of a kind, seeds first, then curated, then others, each by first occurrence."""
    n = nodes.filter((F.lower(F.trim("type")) == kind) & F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    first = n.groupBy("symbol").agg(F.min(F.struct("seq", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"))).alias("f"))
    group = F.when(F.col("f.source") == "seed", 0).when(F.col("f.source") == "curated", 1).otherwise(2)
    # A node table's symbols of one kind: a dimension of thousands of rows.
    return first.select("symbol", F.row_number().over(Window.orderBy(group, "f.seq", "symbol")).alias("place"))


def pair_edges(pairs: DataFrame, source: str, kind: str = "SL_pair") -> DataFrame:
    """Edges both ways for each pair (a, b, seq)."""
    a, b = scalars.node_key("gene", F.col("a")), scalars.node_key("gene", F.col("b"))
    there = pairs.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), F.lit(source).alias("source"), (2 * F.col("seq")).alias("seq"))
    return there.unionByName(pairs.select(b.alias("src"), a.alias("dst"), F.lit(kind).alias("type"), F.lit(source).alias("source"), (2 * F.col("seq") + 1).alias("seq")))


def association_edges(rows: DataFrame, a: str, b: str, score: str, source: str = "STRING", kind: str = "STRING_association") -> DataFrame:
    """One directed edge for each row of an association network, none dropped."""
    return rows.select(scalars.node_key("gene", F.col(a)).alias("src"), scalars.node_key("gene", F.col(b)).alias("dst"), F.lit(kind).alias("type"), F.lit(source).alias("source"), F.col(score).cast("double").alias("score"))


def interactions_in_scope(rows: DataFrame, accessions: DataFrame, limit: int) -> DataFrame:
    """(source, target, seq) of the first interactions with either end among accessions (accession)."""
    known = accessions.select(F.upper("accession").alias("k")).distinct()
    up = rows.withColumn("_s", F.upper("source")).withColumn("_t", F.upper("target"))
    s = up.join(known.withColumnRenamed("k", "_s"), "_s", "left_semi")
    t = up.join(known.withColumnRenamed("k", "_t"), "_t", "left_semi").join(known.withColumnRenamed("k", "_s"), "_s", "left_anti")
    return s.select("source", "target", "seq").unionByName(t.select("source", "target", "seq")).orderBy("seq", "source", "target").limit(limit)


def regulation_rows(raw: DataFrame, genes: DataFrame, targets: DataFrame | None = None, levels: tuple[str, ...] = LEVELS, external: bool = True) -> DataFrame:
    """(tf, target, sign, level, source): regulations of wanted targets; a level that is given must be allowed, a blank one passes.

    genes and targets: symbol. Without external, regulators must be among the genes too.
    """
    row = raw.select(
        F.upper(F.trim(first_of(raw, FIRST["tf"]))).alias("tf"), F.upper(F.trim(first_of(raw, FIRST["target"]))).alias("target"),
        F.upper(F.substring(F.trim(first_of(raw, FIRST["level"])), 1, 1)).alias("level"),
        scalars.regulation_sign(first_of(raw, ("is_stimulation",), "0"), first_of(raw, ("is_inhibition",), "0"), first_of(raw, FIRST["sign"])).alias("sign"),
        first_of(raw, FIRST["origin"], "OmniPath").alias("source"),
    ).filter((F.col("tf") != "") & (F.col("target") != "") & ((F.col("level") == "") | F.col("level").isin(*levels)))
    # Names are hashed by partition, so the far more numerous regulations are not sorted for the join.
    names = lambda df, c: df.select(F.upper(F.trim("symbol")).alias(c)).distinct().hint("shuffle_hash")
    row = row.join(names(genes if targets is None else targets, "target"), "target", "left_semi")
    return row if external else row.join(names(genes, "tf"), "tf", "left_semi").join(names(genes, "target"), "target", "left_semi")


def regulators_per_target(rows: DataFrame, per_target: int = TF_PER_TARGET, total: int = TF_EDGES) -> DataFrame:
    """(target, tf, level, source, rank): the regulators of each target by level, source and name, then the first of all targets in order. Rows that repeat another count once; they share its rank, so one sort does for both."""
    place = F.dense_rank().over(Window.partitionBy("target").orderBy(scalars.level_rank(F.col("level")), "source", "tf", "level"))
    best = rows.select("target", "tf", "level", "source", place.alias("rank")).filter(F.col("rank") <= per_target).distinct()
    return best.orderBy("target", "rank").limit(total).select("target", "tf", "level", "source", "rank")


def codependencies(effects: DataFrame, least: float = LEAST_CORRELATION, most: int = CODEPENDENCIES) -> DataFrame:
    """(a, b, corr): correlations of the genes' effects over the cells that have both, the strongest of those from least on. effects: cell, gene, effect."""
    return tiles.correlations(effects, least).orderBy(F.desc(F.round(F.abs("corr"), 12)), "a", "b").limit(most)


def capped_pathways(rows: DataFrame, core: DataFrame, cap: int = 3, core_cap: int = 10) -> DataFrame:
    """Pathways of each gene (gene, pos, ...) up to its cap, a larger one for core genes (gene); a cap of 0 or less keeps all."""
    known = rows.join(core.select("gene", F.lit(core_cap).alias("_cap")).distinct(), "gene", "left").withColumn("_cap", F.coalesce("_cap", F.lit(cap)))
    rank = F.row_number().over(Window.partitionBy("gene").orderBy("pos"))
    return known.withColumn("rank", rank).filter((F.col("_cap") <= 0) | (F.col("rank") <= F.col("_cap"))).drop("_cap")


def drivers(rows: DataFrame, cohorts: DataFrame, per_cohort: int = DRIVERS) -> DataFrame:
    """(cohort, gene, role, score, rank): the last row of each tumour and gene, for every cohort of the tumour (cohort, tumor), the first per_cohort by first occurrence."""
    last = rows.groupBy("tumor", "gene").agg(F.max_by(F.struct("role", "score"), "seq").alias("i"), F.min("seq").alias("seq"))
    told = last.join(cohorts, "tumor").select("cohort", "gene", "i.role", "i.score", "seq")
    return graph.top_per(told, ("cohort",), per_cohort, "seq", "gene").drop("seq")


#: Names of the columns of a driver table, the first that it has counts.
DRIVER_COLUMNS = {
    "gene": ("gene", "symbol", "hgnc_symbol", "gene_symbol", "gene_name"), "tumor": ("tumor_type", "cancer_type", "cohort"), "role": ("role", "mode_of_action", "moa"),
    "score": ("qvalue", "q_value", "qvalue_combination", "q_value_combination", "fdr", "pvalue"),
}


def driver_rows(raw: DataFrame, genes: DataFrame, tumors: DataFrame, seq: str = "seq") -> DataFrame:
    """(tumor, gene, role, score, seq) of a driver table whose columns go by one of several names, in any case; of wanted genes (symbol) and tumours (tumor) only.

    A tumour is told with the prefix of its project or a suffix of its country, which go where the rest is wanted. Without a column for genes or tumours there are no rows.
    """
    have = {c.lower(): c for c in reversed(raw.columns)}
    found = {k: next((have[n] for n in names if n in have), None) for k, names in DRIVER_COLUMNS.items()}
    told = lambda k: F.coalesce(F.col(f"`{found[k]}`").cast("string"), F.lit("")) if found[k] else F.lit("")
    wanted = lambda df, c: df.select(F.upper(F.trim(c)).alias("_w")).distinct()
    gene, tumor = F.upper(F.trim(told("gene"))), F.regexp_replace(F.upper(F.trim(told("tumor"))), "^TCGA-", "")
    rows = raw.select(gene.alias("gene"), tumor.alias("tumor"), told("role").alias("role"), told("score").alias("score") if found["score"] else F.lit(None).cast("string").alias("score"), F.col(seq).alias("seq")).filter("gene <> '' AND tumor <> ''")
    rows = rows.join(wanted(genes, "symbol").withColumnRenamed("_w", "gene"), "gene", "left_semi")
    known = wanted(tumors, "tumor")
    rows = rows.join(known.select(F.col("_w").alias("tumor"), F.lit(True).alias("_known")), "tumor", "left").withColumn("tumor", F.when(F.col("_known"), F.col("tumor")).otherwise(F.substring_index("tumor", "-", 1)))
    return rows.join(known.withColumnRenamed("_w", "tumor"), "tumor", "left_semi").select("tumor", "gene", "role", "score", "seq")


def target_edges(rows: DataFrame, per_gene: int = DRUG_ROWS) -> DataFrame:
    """Edges from drugs to genes: the first rows (gene, pos, drug_id, phase, mechanism, disease) of each gene."""
    few = graph.top_per(rows, ("gene",), per_gene, "pos")
    return few.select(scalars.node_key("drug", F.col("drug_id")).alias("src"), scalars.node_key("gene", F.col("gene")).alias("dst"), F.lit("targets").alias("type"), F.lit("OpenTargets").alias("source"), F.col("phase").cast("double").alias("phase"), "mechanism", "disease")


def merge_nodes(contributions: DataFrame, keep: tuple[str, ...], last: bool = False) -> DataFrame:
    """One row for each node_id: the attributes of the first contribution by (step, seq) that has a type, or for each attribute the last non-null one."""
    if last:
        return contributions.groupBy("node_id").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("step", "seq"))).alias(c) for c in keep))
    order = F.struct(F.col("type").isNull().alias("untyped"), F.col("step"), F.col("seq"))
    return contributions.groupBy("node_id").agg(F.min_by(F.struct(*keep), order).alias("n")).select("node_id", *(F.col(f"n.{c}").alias(c) for c in keep))


def merge_edges(steps: list[DataFrame], attributes: tuple[str, ...] = ()) -> DataFrame:
    """All steps' edges with keys in build order: by step and, within it, by seq, then by their own columns; attributes that a step lacks are null. A step whose rows have no order of their own (no
    seq) is ordered by its columns alone."""
    whole = None
    for i, s in enumerate(steps):
        if "seq" not in s.columns:
            s = s.withColumn("seq", F.lit(0).cast("long"))
        s = s.withColumn("step", F.lit(i))
        whole = s if whole is None else whole.unionByName(s, allowMissingColumns=True)
    for c in attributes:
        if c not in whole.columns:
            whole = whole.withColumn(c, F.lit(None).cast("string"))
    return graph.with_keys(whole, "step", "seq", *(c for c in whole.columns if c not in ("step", "seq")))


def upsert(nodes: DataFrame, delta: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Nodes with a delta merged in: new ones added, blank attributes of known ones filled."""
    blank = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    both = nodes.alias("n").join(delta.alias("d"), "node_id", "full")
    return both.select("node_id", *(F.coalesce(blank(F.col(f"n.{c}")), F.col(f"d.{c}"), F.col(f"n.{c}")).alias(c) for c in attributes))


def new_edges(edges: DataFrame, delta: DataFrame, on: tuple[str, ...] = ("src", "dst", "type", "source")) -> DataFrame:
    """The delta's edges that no edge matches."""
    return delta.join(edges.select(*on), list(on), "left_anti")


def cache_aside(requested: DataFrame, cache: DataFrame, fetch, key: str) -> tuple[DataFrame, DataFrame]:
    """(answers for the requested keys, rows to add to the cache): cached rows, and what fetch gives for the keys that are missing.

    fetch takes a DataFrame of keys and returns rows like the cache's; keys that it finds nothing for stay unanswered.
    """
    missing = requested.select(key).distinct().join(cache.select(key), key, "left_anti")
    fresh = fetch(missing).select(*cache.columns)
    return requested.select(key).distinct().join(cache.unionByName(fresh), key, "left"), fresh
