"""Building a graph as one call: the steps in order, each giving its contributions of nodes and edges, merged once at the end.

Sources are tables; a step without its table, or one that is skipped, adds nothing. Later steps see the genes that earlier ones added, with the first
contribution of each. Caps count in the order that seq gives.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..runtime import saved
from . import construction, graph

#: How many genes a step asks for, and interactions that it takes.
ACCESSION_GENES, INTERACTIONS, CONTEXT_GENES = 20, 1000, 200
NODE_COLUMNS = ("type", "symbol", "name", "accession", "source", "is_tf")
EDGE_COLUMNS = ("score", "corr", "phase", "level", "sign", "context", "note", "role", "mechanism", "disease", "mutations")
STEPS = ("string", "omnipath", "tf_regulation", "depmap", "reactome", "cbioportal", "cancer_driver", "opentargets")
#: Steps after which there may be other genes.
ADD_GENES = ("string", "tf_regulation")


@dataclass(frozen=True)
class Sources:
    """Tables of the steps; seq is the order of a table's rows."""

    seed_pairs: DataFrame  # a, b, seq
    curated: DataFrame  # a, b, seq, context, note
    associations: DataFrame | None = None  # a, b, score, seq
    accessions: DataFrame | None = None  # gene, accession
    interactions: DataFrame | None = None  # source, target, seq
    regulations: DataFrame | None = None  # tf, target, level, sign, source
    effects: DataFrame | None = None  # cell, gene, effect
    pathways: DataFrame | None = None  # gene, pos, pathway_id, name
    cohorts: DataFrame | None = None  # cohort, tumor
    drivers: DataFrame | None = None  # tumor, gene, role, score, seq
    drugs: DataFrame | None = None  # gene, pos, drug_id, phase, mechanism, disease
    not_genes: tuple[str, ...] = ()
    levels: tuple[str, ...] = construction.LEVELS
    external: bool = True
    context_stub: bool = False
    caps: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame  # node_id and NODE_COLUMNS, neighbor_genes, neighbor_gene_count
    edges: DataFrame  # src, dst, key, type, source and EDGE_COLUMNS


def _nodes(df: DataFrame, node_id: Column, kind: str, step: int, seq: Column, **known: Column) -> DataFrame:
    told = {"type": F.lit(kind), **known}
    return df.select(node_id.alias("node_id"), *(told.get(c, F.lit(None)).cast("boolean" if c == "is_tf" else "string").alias(c) for c in NODE_COLUMNS), F.lit(step).alias("step"), seq.cast("long").alias("seq"))


def _edges(df: DataFrame, src: Column, dst: Column, kind: str, source: Column, seq: Column, **known: Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), source.alias("source"), *(c.cast("string").alias(n) for n, c in known.items()), seq.cast("long").alias("seq"))


def _gene(c: str) -> Column:
    return scalars.node_key("gene", F.col(c))


def _by_shuffle(df: DataFrame) -> DataFrame:
    """df, a table with a row for each gene or node, for joins that shuffle it: a broadcast would pass it through the driver."""
    return df.hint("merge")


def _numbered(df: DataFrame, *order) -> DataFrame:
    """df with seq, its rows' places in that order; for contributions that a cap has bounded."""
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*order)))


def base(sources: Sources) -> tuple[DataFrame, DataFrame]:
    """Genes of the seed pairs, then of the curated pairs, each by first occurrence; both pair lists as edges both ways."""
    odd = list(sources.not_genes)

    def genes(pairs: DataFrame, source: str, step: int) -> DataFrame:
        ends = pairs.select(F.explode(F.array(F.struct(F.trim("a").alias("g"), (2 * F.col("seq")).alias("seq")), F.struct(F.trim("b").alias("g"), (2 * F.col("seq") + 1).alias("seq")))).alias("e")).select("e.*")
        return _nodes(ends.filter((F.col("g") != "") & ~F.col("g").isin(*odd) if odd else F.col("g") != ""), _gene("g"), "gene", step, F.col("seq"), symbol=F.col("g"), source=F.lit(source))

    nodes = genes(sources.seed_pairs, "seed", 0).unionByName(genes(sources.curated, "curated", 1))
    known = sources.curated.filter("a IS NOT NULL AND b IS NOT NULL AND a <> '' AND b <> ''")
    if odd:
        known = known.filter(~F.col("a").isin(*odd) & ~F.col("b").isin(*odd))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    both = known.select("a", "b", "seq", blank("context").alias("context"), blank("note").alias("note"))
    pairs = construction.pair_edges(sources.seed_pairs, "seed")
    for x, y, turn in (("a", "b", 0), ("b", "a", 1)):
        # After the seeds' edges, whose numbers are below.
        pairs = pairs.unionByName(_edges(both, _gene(x), _gene(y), "SL_pair", F.lit("curated"), (1 << 40) + 2 * F.col("seq") + turn, context=F.col("context"), note=F.col("note")), allowMissingColumns=True)
    return nodes, pairs


def _string(s: Sources, genes: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    a = s.associations
    nodes = _nodes(a, _gene("a"), "gene", step, 2 * F.col("seq"), symbol=F.col("a"), source=F.lit("STRING")).unionByName(_nodes(a, _gene("b"), "gene", step, 2 * F.col("seq") + 1, symbol=F.col("b"), source=F.lit("STRING")))
    return nodes, _edges(a, _gene("a"), _gene("b"), "STRING_association", F.lit("STRING"), F.col("seq"), score=F.col("score"))


def _omnipath(s: Sources, genes: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    few = genes.filter(F.col("place") <= s.caps.get("accession_genes", ACCESSION_GENES)).select(F.col("symbol").alias("gene"), "place")
    known = few.join(s.accessions, "gene")
    rows = saved(construction.interactions_in_scope(s.interactions, known.select("accession"), s.caps.get("interactions", INTERACTIONS)), "build-rows")
    protein = lambda c: scalars.node_key("protein", F.upper(F.col(c)))
    made = lambda df, c, seq: _nodes(df, protein(c), "protein", step, seq, accession=F.upper(F.col(c)), source=F.lit("OmniPath"))
    nodes = made(rows, "source", 2 * F.col("seq")).unionByName(made(rows, "target", 2 * F.col("seq") + 1)).unionByName(made(known, "accession", (1 << 40) + F.col("place")))
    edges = _edges(rows, protein("source"), protein("target"), "OmniPath_interaction", F.lit("OmniPath"), F.col("seq"))
    return nodes, edges.unionByName(_edges(known, _gene("gene"), protein("accession"), "encodes", F.lit("UniProt/OmniPath"), (1 << 40) + F.col("place")))


def mapped_regulations(rows: DataFrame, genes: DataFrame, accessions: DataFrame | None, external: bool = True) -> DataFrame:
    """rows (tf, target, ...) with accessions that stand for known genes (symbol) as their symbols, and how the regulator is held: gene, new gene or protein. Rows with an unknown target go, and
    without external those with an unknown regulator."""
    known = _by_shuffle(genes.select(F.upper(F.trim("symbol")).alias("_g"), F.lit(True).alias("_in")).distinct())
    to = None if accessions is None else accessions.groupBy(F.upper(F.trim("accession")).alias("_acc")).agg(F.max(F.upper(F.trim("gene"))).alias("_sym")).transform(_by_shuffle)
    for c in ("tf", "target"):
        rows = rows.withColumn(c, F.upper(F.trim(c))).join(known, F.col(c) == F.col("_g"), "left").drop("_g")
        if to is not None:
            # An accession is mapped only where the text is no known gene itself.
            rows = rows.join(to, F.col(c) == F.col("_acc"), "left").withColumn(f"_was_{c}", F.col(c)).withColumn(c, F.when(F.col("_in").isNull() & F.col("_sym").isNotNull(), F.col("_sym")).otherwise(F.col(c))).drop("_acc", "_sym")
            rows = rows.drop("_in").join(known, F.col(c) == F.col("_g"), "left").drop("_g")
        else:
            rows = rows.withColumn(f"_was_{c}", F.col(c))
        rows = rows.withColumn(f"_{c}_known", F.coalesce("_in", F.lit(False))).drop("_in")
    held = F.when(F.col("_tf_known"), "gene").when(scalars.is_accession(F.col("_was_tf")), "protein").otherwise("new gene")
    rows = rows.filter("_target_known AND tf <> ''").withColumn("held", held)
    return (rows if external else rows.filter("held = 'gene'")).drop("_tf_known", "_target_known", "_was_tf", "_was_target")


def _tf_regulation(s: Sources, genes: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    rows = s.regulations.filter((F.trim("tf") != "") & (F.trim("target") != ""))
    level = F.upper(F.substring(F.trim(F.coalesce("level", F.lit(""))), 1, 1))
    rows = rows.withColumn("level", level).filter((F.col("level") == "") | F.col("level").isin(*s.levels))
    best = graph.top_per(rows, ("target",), s.caps.get("tf_per_target", construction.TF_PER_TARGET), scalars.level_rank(F.col("level")), "source", "tf", "sign")
    told = mapped_regulations(best, genes, s.accessions, s.external)
    few = saved(_numbered(told.orderBy("target", "rank", "tf").limit(s.caps.get("tf_edges", construction.TF_EDGES)), "target", "rank", "tf", "source", "sign"), "build-rows")
    node = F.when(F.col("held") == "protein", scalars.node_key("protein", F.col("tf"))).otherwise(_gene("tf"))
    origin = F.lit("DoRothEA/OmniPath")
    of = lambda kind, own, **known: _nodes(few.filter(F.col("held").isin(*own)), node, kind, step, F.col("seq"), source=origin, is_tf=F.lit(True), **known)
    nodes = of("protein", ("protein",), accession=F.col("tf")).unionByName(of("gene", ("new gene", "gene"), symbol=F.col("tf")))
    source = F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise(origin)
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    return nodes, _edges(few, node, _gene("target"), "TF_regulates", source, F.col("seq"), sign=blank("sign"), level=blank("level"))


def _depmap(s: Sources, genes: DataFrame, step: int) -> tuple[None, DataFrame]:
    wanted = genes.filter(F.col("place") <= s.caps.get("effect_genes", 200)).select(F.col("symbol").alias("gene"))
    rows = construction.codependencies(s.effects.join(wanted, "gene", "left_semi"), most=s.caps.get("codependencies", construction.CODEPENDENCIES))
    rows = saved(_numbered(rows, F.desc(F.round(F.abs("corr"), 12)), "a", "b"), "build-rows")
    one = lambda x, y, turn: _edges(rows, _gene(x), _gene(y), "DepMap_codependency", F.lit("DepMap"), 2 * F.col("seq") + turn, corr=F.col("corr"))
    return None, one("a", "b", 0).unionByName(one("b", "a", 1))


def _reactome(s: Sources, genes: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    core = s.seed_pairs.select(F.explode(F.array(F.trim("a"), F.trim("b"))).alias("gene")).distinct()
    rows = construction.capped_pathways(s.pathways.join(_by_shuffle(genes.select(F.col("symbol").alias("gene"), "place")), "gene"), core, s.caps.get("pathways", 3), s.caps.get("core_pathways", 10))
    rows = saved(rows.select("gene", "pathway_id", "name", "place", "rank"), "build-rows")
    node, seq = scalars.node_key("pathway", F.col("pathway_id")), F.col("place").cast("long") * 10_000 + F.col("rank")
    return _nodes(rows, node, "pathway", step, seq, name=F.col("name"), source=F.lit("Reactome")), _edges(rows, _gene("gene"), node, "in_pathway", F.lit("Reactome"), seq)


def _without_hubs(nodes: DataFrame, edges: DataFrame, genes: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without hubs (hub) that are linked to no gene or to all of them."""
    gone = graph.hub_or_isolated(edges.select(F.col("src").alias("gene"), F.col("dst").alias("hub")), "gene", "hub", genes.select(_gene("symbol").alias("gene")), hubs)
    return nodes.join(gone.withColumnRenamed("hub", "node_id"), "node_id", "left_anti"), edges.join(gone.withColumnRenamed("hub", "dst"), "dst", "left_anti")


def _cbioportal(s: Sources, genes: DataFrame, step: int) -> tuple[DataFrame, DataFrame] | None:
    """A placeholder that links every gene to every cohort, off by default: it makes hubs that tell nothing, and those that reach all genes go again."""
    if not s.context_stub:
        return None
    few = genes.filter(F.col("place") <= s.caps.get("context_genes", CONTEXT_GENES))
    cohorts = s.cohorts.select("cohort").distinct()
    links = few.crossJoin(F.broadcast(cohorts))  # a few hundred genes and the study list
    node = scalars.node_key("cohort", F.col("cohort"))
    nodes = _nodes(cohorts, node, "cohort", step, F.lit(0), name=F.col("cohort"), source=F.lit("cBioPortal"))
    edges = _edges(_numbered(links, "cohort", "place"), _gene("symbol"), node, "mutated_in", F.lit("cBioPortal"), F.col("seq"), mutations=F.lit(1), context=F.col("cohort"))
    return _without_hubs(nodes, edges, genes, cohorts.select(node.alias("hub")))


def _cancer_driver(s: Sources, genes: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    known = s.drivers.join(_by_shuffle(genes.select(F.col("symbol").alias("gene"))), "gene", "left_semi")
    rows = construction.drivers(known, s.cohorts, s.caps.get("drivers", construction.DRIVERS))
    node = scalars.node_key("cohort", F.col("cohort"))
    nodes = _nodes(s.cohorts.select("cohort").distinct(), node, "cohort", step, F.lit(0), name=F.col("cohort"), source=F.lit("IntOGen"))
    edges = _edges(_numbered(rows, "cohort", "rank", "gene"), _gene("gene"), node, "driver_in", F.lit("IntOGen"), F.col("seq"), role=F.col("role"), score=F.col("score"))
    return _without_hubs(nodes, edges, genes, s.cohorts.select(node.alias("hub")))


def _opentargets(s: Sources, genes: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    few = graph.top_per(s.drugs.join(_by_shuffle(genes.select(F.col("symbol").alias("gene"), "place")), "gene"), ("gene",), s.caps.get("drug_rows", construction.DRUG_ROWS), "pos", "drug_id", "phase", "mechanism", "disease")
    few = saved(few.select("gene", "drug_id", "phase", "mechanism", "disease", "place", "rank"), "build-rows")
    seq, node = F.col("place").cast("long") * 10_000 + F.col("rank"), scalars.node_key("drug", F.col("drug_id"))
    nodes = _nodes(few, node, "drug", step, seq, source=F.lit("OpenTargets"))
    return nodes, _edges(few, node, _gene("gene"), "targets", F.lit("OpenTargets"), seq, phase=F.col("phase"), mechanism=F.col("mechanism"), disease=F.col("disease"))


_RUN = {"string": (_string, ("associations",)), "omnipath": (_omnipath, ("accessions", "interactions")), "tf_regulation": (_tf_regulation, ("regulations",)), "depmap": (_depmap, ("effects",)), "reactome": (_reactome, ("pathways",)), "cbioportal": (_cbioportal, ("cohorts",)), "cancer_driver": (_cancer_driver, ("drivers", "cohorts")), "opentargets": (_opentargets, ("drugs",))}


def merged(contributions: DataFrame) -> DataFrame:
    """One row for each node: type and texts of its first contribution, the first of each attribute that has one; a node is a regulator if any contribution says so.

    Contributions that tell the same are one before the first of each attribute is sought, so a table that names a node in many rows gives it one row a task.
    """
    contributions = contributions.groupBy("node_id", "step", *NODE_COLUMNS).agg(F.min("seq").alias("seq"))
    order = F.struct("step", "seq", *(c for c in NODE_COLUMNS if c != "is_tf"))
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in NODE_COLUMNS if c != "is_tf"]
    return contributions.groupBy("node_id").agg(*first, F.min(F.struct("step", "seq")).alias("_first"), F.max(F.coalesce("is_tf", F.lit(False))).alias("is_tf"))


def _held(contributions: DataFrame) -> DataFrame:
    """The contributions so far as one for each node, in its first one's place. Later steps come after all of them, so these stand for them in the next merge."""
    return saved(merged(contributions).select("node_id", *NODE_COLUMNS, F.col("_first.step").alias("step"), F.col("_first.seq").alias("seq")), "build-nodes")


def build(sources: Sources, skip: frozenset[str] | set[str] = frozenset()) -> Graph:
    """The graph of all steps but the skipped ones: first contribution wins, edges keyed in build order, types in lower case, and each gene with its first neighbours of that kind."""
    if unknown := sorted(set(skip) - set(STEPS)):
        raise ValueError(f"unknown steps {unknown}")
    contributed, edges = base(sources)
    held, steps, genes = _held(contributed), [edges], None
    for number, name in enumerate(STEPS, 2):
        run, needs = _RUN[name]
        if name in skip or any(getattr(sources, n) is None for n in needs):
            continue
        if genes is None:
            now = held.select("type", "symbol", "source", (F.col("step") * F.lit(1 << 44) + F.col("seq")).alias("seq"))
            genes = saved(construction.prioritized(now), "build-genes")
        if (made := run(sources, genes, number)) is None:
            continue
        nodes, edges = made
        if nodes is not None:
            held = _held(held.unionByName(nodes))
            genes = None if name in ADD_GENES else genes
        steps.append(edges)
    nodes = held.drop("step", "seq").withColumn("type", F.lower(F.trim("type")))
    edges = saved(construction.merge_edges(steps, EDGE_COLUMNS).select("src", "dst", "key", "type", "source", *EDGE_COLUMNS), "build-edges")
    told = graph.neighbor_gene_cache(edges, nodes).withColumnRenamed("node", "node_id")
    return Graph(nodes.join(_by_shuffle(told), "node_id", "left"), edges)
