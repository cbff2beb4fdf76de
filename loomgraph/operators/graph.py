"""Operators on a typed multigraph held as two tables, nodes and edges.

edges: src, dst, type, source and attributes; key numbers parallel edges. nodes: node_id, type and attributes. Every operator works on all
pairs, seeds or groups of its input at once, keyed by columns that it carries along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved
from . import walks


def with_keys(edges: DataFrame, *order: str, by: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """edges with key: the number, from 0, of each edge among those of one direction between two nodes, in that order. by names columns that tell directions apart as src and dst do; numbers are dealt and sorted faster than names."""
    return edges.withColumn("key", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end: a, b and direction (forward, reverse); the other columns stay."""
    other = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("forward").alias("direction"), *other)
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("reverse").alias("direction"), *other)
    return there.unionByName(back)


def _turned(*columns: str) -> Column:
    """Rows (a, b, columns) of an unordered pair (_low, _high), seen from either end."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), *columns)
    return F.explode(F.array(way("_low", "_high"), way("_high", "_low"))).alias("_way")


def neighbors(edges: DataFrame, *other: str) -> DataFrame:
    """Distinct (a, b, other columns) with an edge either way, loops left out. Pairs are made distinct before they are turned round, so that each edge is read and sent once."""
    pairs = edges.select(F.least("src", "dst").alias("_low"), F.greatest("src", "dst").alias("_high"), *other).filter("_low <> _high").distinct()
    return pairs.select(_turned(*other)).select("_way.*")


def undirected_degree(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct pairs of neighbour and key, so reciprocal edges that share a key count once; a loop counts twice."""
    back = F.col("src").isNull() | (F.col("src") > F.col("dst"))
    pairs = edges.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("_low"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("_high"), "key").distinct()
    return pairs.select(F.explode(F.array("_low", "_high")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def neighbors_by_type(edges: DataFrame) -> DataFrame:
    """(node, type, neighbors): for each node and edge type the sorted neighbours either way."""
    return both_ways(edges.select("src", "dst", "type")).groupBy(F.col("a").alias("node"), F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.array_sort(F.collect_set("b")).alias("neighbors"))


def neighbor_gene_cache(edges: DataFrame, nodes: DataFrame, kind: str = "gene", cap: int = 30) -> DataFrame:
    """(node, neighbor_genes, neighbor_gene_count): for each node of the kind its first neighbours of that kind by symbol; the count is taken after the cap.

    The cap is a rank, so no hub's neighbours are gathered in one row. Nodes are joined by a shuffle, so that they do not pass through the driver.
    """
    of_kind = nodes.filter(F.col("type") == kind).select("node_id", "symbol").hint("merge")
    pairs = neighbors(edges).join(of_kind.select(F.col("node_id").alias("a")), "a").join(of_kind.select(F.col("node_id").alias("b"), "symbol"), "b")
    first = pairs.select("a", "symbol").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("symbol"))).filter(F.col("rank") <= cap)
    lists = first.groupBy("a").agg(F.array_sort(F.collect_list("symbol")).alias("list"))
    return of_kind.select(F.col("node_id").alias("node")).join(lists.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce(F.array_join("list", ","), F.lit("")).alias("neighbor_genes"), F.coalesce(F.array_size("list"), F.lit(0)).alias("neighbor_gene_count"))


def dominant_type(members: DataFrame, nodes: DataFrame, group: str | tuple[str, ...], limit: int | None = None) -> DataFrame:
    """(group, type, node, rank): a group's members of its most frequent node type (ties: first by name), sorted, the first limit of them. Members are dealt by group once, and counted and ranked where they are."""
    keys = (group,) if isinstance(group, str) else group
    typed = members.select(*keys, "node").join(nodes.select(F.col("node_id").alias("node"), F.coalesce("type", F.lit("unknown")).alias("type")), "node", "left").fillna("unknown", ["type"])
    dealt = typed.repartition(*keys).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "type")))
    best = dealt.withColumn("_best", F.min(F.struct(-F.col("_n"), "type")).over(Window.partitionBy(*keys))).filter("_best.type = type")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("node")))
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select(*keys, "type", "node", "rank")


def best_scores(edges: DataFrame, score: str = "evidence") -> DataFrame:
    """(a, b, best): the highest score of the edges between two nodes, either way, once for each unordered pair."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(score).alias("best"))


def best_edges(edges: DataFrame, score: str = "evidence", by: tuple[str, ...] | None = None) -> DataFrame:
    """(a, b, src, dst, key, type, source, best): the edge of the highest score between two nodes; ties to the smallest src, dst, key.

    by names columns that tell unordered pairs apart as the nodes' names do: edges that are dealt by them already, as for their keys, are not dealt again.
    """
    low, high = F.least("src", "dst").alias("_low"), F.greatest("src", "dst").alias("_high")
    ranked = F.struct((-F.col(score)).alias("s"), "src", "dst", "key", "type", "source")
    best = edges.groupBy(*(by or (low, high))).agg(F.min(ranked).alias("e"))
    return best.select(F.least("e.src", "e.dst").alias("a"), F.greatest("e.src", "e.dst").alias("b"), "e.src", "e.dst", "e.key", "e.type", "e.source", (-F.col("e.s")).alias("best"))


def best_score_to_cores(edges: DataFrame, cores: DataFrame, score: str = "evidence") -> DataFrame:
    """(group, node, best): for each group's cores (group, core) the highest score of the edges between a node and one of them."""
    return both_ways(edges.select("src", "dst", score)).join(cores.select("group", F.col("core").alias("a")), "a").groupBy("group", F.col("b").alias("node")).agg(F.max(score).alias("best"))


def pick_steps(pairs: DataFrame | None, edges: DataFrame, priority: dict[str, int]) -> DataFrame:
    """For each wanted (a, b), or without pairs for every two nodes with an edge between them, the edge that explains it: by type priority, forward before reverse, type name, key.

    direction is both where edges lead both ways; a pair without an edge gets the placeholder related_to, unknown. The best edge of each direction is found for each unordered pair, and only these are turned round.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))[F.col("type")], F.lit(99)) if priority else F.lit(99)
    told = edges.select("src", "dst", "key", F.coalesce("type", F.lit("related_to")).alias("type"), F.coalesce("source", F.lit("unknown")).alias("source"))
    low, high = F.least("src", "dst").alias("_low"), F.greatest("src", "dst").alias("_high")
    if pairs is None:
        told = told.filter("src <> dst")
    else:
        wanted = pairs.select("a", "b").distinct()
        told = told.select("*", low, high).join(wanted.select(F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high")), ["_low", "_high"], "left_semi")
    first = lambda end: F.min(F.when(F.col("src") == F.col(end), F.col("e")))
    both = told.select("src", F.struct(rank.alias("rank"), "type", "key", "source").alias("e"), low, high).groupBy(F.xxhash64("_low", "_high").alias("_h"), "_low", "_high").agg(first("_low").alias("up"), first("_high").alias("down"))
    turned = lambda a, b, there, back: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(there).alias("forward"), F.col(back).alias("reverse"))
    ways = F.array(turned("_low", "_high", "up", "down"), turned("_high", "_low", "down", "up"))
    found = both.select(F.explode(F.when(F.col("_low") == F.col("_high"), F.slice(ways, 1, 1)).otherwise(ways)).alias("w")).select("w.*")
    own = lambda way: F.when(F.col(way).isNotNull(), F.struct(F.col(f"{way}.rank").alias("rank"), F.lit(way).alias("direction"), F.col(f"{way}.type").alias("type"), F.col(f"{way}.key").alias("key"), F.col(f"{way}.source").alias("source")))
    found = found.select("a", "b", F.least(own("forward"), own("reverse")).alias("e"), (F.col("forward").isNotNull() & F.col("reverse").isNotNull()).alias("ways"))
    if pairs is not None:
        found = wanted.join(found, ["a", "b"], "left")
    return found.select(
        "a", "b", F.coalesce("e.type", F.lit("related_to")).alias("edge_type"), F.coalesce("e.source", F.lit("unknown")).alias("edge_source"),
        F.when(F.col("ways"), "both").otherwise(F.coalesce("e.direction", F.lit("unknown"))).alias("direction"), F.col("e.key").alias("edge_key"),
    )


def weighted_undirected(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(a, b, weight): the simple graph, each pair with the highest weight of its edges' types; unknown types weigh 0."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.coalesce("type", F.lit("related_to"))], F.lit(0.0))
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(weight).alias("weight"))


def khop(seeds: DataFrame, edges: DataFrame, k: int, *, by: tuple[str, ...] = ("start",), edge_by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node, hops): hop distances up to k from each seed (by..., node), all seeds at once.

    edge_by names columns that the seeds share with the edges, such as the source: then only edges of the same value are followed. The first level
    joins the seeds to their neighbours, the others follow lists of neighbours block by block (walks); what has been seen is dropped.
    """
    keys = [*by, *edge_by]
    step = neighbors(edges, *edge_by)
    step = saved(step, "hops-steps") if k > 1 else step
    seen = seeds.select(*keys, "node").distinct().withColumn("hops", F.lit(0))
    frontier = before = seen
    for level in range(1, k + 1):
        if level == 1:
            reached = frontier.withColumnRenamed("node", "a").drop("hops").join(step, ["a", *edge_by]).select(*keys, F.col("b").alias("node"), F.lit(1).alias("hops"))
            ball = seen.unionByName(reached).groupBy(*keys, "node").agg(F.min("hops").alias("hops"))
            if k == 1:
                return ball
            frontier = ball.filter("hops = 1").drop("hops")
        else:
            frontier = walks.followed(frontier, step, before, by=by, edge_by=edge_by)
        before = seen
        frontier = frontier.withColumn("hops", F.lit(level))
        frontier = saved(frontier, "hops") if level < k else frontier
        seen = seen.unionByName(frontier)
    return seen


def distances(ends: DataFrame, edges: DataFrame, cutoff: int, name: str, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(pair_id, node, name): hop distances up to cutoff from each pair's ends (pair_id, node). A node that is an end of many pairs is searched from once; several ends of a pair give the least.

    keep tells of a node and a distance whether it is wanted, and wants the lesser one where it wants the greater; what it does not want is not gathered.
    """
    own = ends.select("pair_id", F.col("node").alias("start")).distinct()
    if cutoff == 1:  # a search that starts at one node finds every neighbour once
        if keep is None:
            step = neighbors(edges)
        else:
            turned = edges.select(F.col("src").alias("_low"), F.col("dst").alias("_high")).filter("_low <> _high").select(_turned()).select("_way.*")
            step = turned.filter(keep(F.col("b"), F.lit(1))).distinct()
        reached = step.join(own.withColumnRenamed("start", "a"), "a").select("pair_id", F.col("b").alias("node"), F.lit(1).alias("hops"))
        found = own.select("pair_id", F.col("start").alias("node"), F.lit(0).alias("hops")).unionByName(reached)
    else:
        balls = khop(own.select("start", F.col("start").alias("node")).distinct(), edges, cutoff)
        found = own.join(balls, "start").select("pair_id", "node", "hops")
    found = found if keep is None else found.filter(keep(F.col("node"), F.col("hops")))
    return found.groupBy("pair_id", "node").agg(F.min("hops").alias(name))


def shortest_path_nodes(pairs: DataFrame, edges: DataFrame, cutoff: int) -> DataFrame:
    """(pair_id, node): the nodes on any shortest path of at most cutoff hops between a pair's ends.

    The searches from both ends meet half-way, so neither goes further than half the cutoff; from where they meet the shortest paths are walked back to the ends.
    """
    here, there = (cutoff + 1) // 2, cutoff // 2
    side = lambda c, n: pairs.select("pair_id", F.col(c).alias("start"), F.lit(n).alias("most"))
    ends = side("a", here).withColumn("first", F.lit(True)).unionByName(side("b", there).withColumn("first", F.lit(False)))
    balls = ends.join(khop(ends.select("start", F.col("start").alias("node")).distinct(), edges, here), "start").filter("hops <= most")
    reach = balls.groupBy("pair_id", "node").agg(F.min(F.when(F.col("first"), F.col("hops"))).alias("da"), F.min(F.when(~F.col("first"), F.col("hops"))).alias("db"))
    met = reach.filter("da IS NOT NULL AND db IS NOT NULL")
    if here > 1:  # the way back reads them again
        reach = saved(reach, "paths-reach")
        met = saved(reach.filter("da IS NOT NULL AND db IS NOT NULL"), "paths-met")
    least = met.groupBy("pair_id").agg(F.min(F.col("da") + F.col("db")).alias("d"))
    middle = met.join(least, "pair_id").filter("da + db = d").select("pair_id", "node", "da", "db")
    found = middle.select("pair_id", "node")
    for col, far in (("da", here), ("db", there)):
        level = middle
        for hops in range(far - 1, 0, -1):
            step = both_ways(edges.select("src", "dst")).select(F.col("a").alias("node"), "b")
            back = level.filter(F.col(col) == hops + 1).join(step, "node").select("pair_id", F.col("b").alias("node")).distinct().join(reach.filter(F.col(col) == hops).select("pair_id", "node", col), ["pair_id", "node"])
            level = saved(back.select("pair_id", "node", col).unionByName(middle.filter(F.col(col) == hops).select("pair_id", "node", col)).distinct(), "paths-back")
            found = found.unionByName(level.select("pair_id", "node"))
    joined = pairs.join(least.select("pair_id"), "pair_id", "left_semi").select("pair_id", F.explode(F.array("a", "b")).alias("node"))
    return found.unionByName(joined).distinct()


def min_core_distance(cores: DataFrame, edges: DataFrame, cutoff: int, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(pair_id, node, dist): the least hop distance of a node from its pair's cores (pair_id, node), of what keep wants."""
    return distances(cores, edges, cutoff, "dist", keep)


def incident_edges(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """The edges that touch a centre (node)."""
    c = centers.select("node").distinct()
    at_src = edges.join(c.withColumnRenamed("node", "src"), "src", "left_semi")
    at_dst = edges.join(c.withColumnRenamed("node", "dst"), "dst", "left_semi").join(c.withColumnRenamed("node", "src"), "src", "left_anti")
    return at_src.unionByName(at_dst.select(*at_src.columns))


def first_incident(edges: DataFrame, groups: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """(pair_id, edge columns): of each group's nodes (pair_id, node) the first n edges at each of them, either way, in a total order. They hold the first n edges of the group, and a hub's others are never dealt to its groups."""
    at = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "*")  # one pass: two would key the edges twice
    few = top_per(at.join(groups.select("node").distinct(), "node", "left_semi"), ("node",), n, *order)
    return few.join(groups.select("pair_id", "node").distinct(), "node").select("pair_id", *edges.columns).distinct()


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(pair_id, edge columns): edges with both ends among a pair's members (pair_id, node).

    A step is followed from that of its ends that is a member of fewer pairs, without attributes; only edges of the steps that are left are looked up.
    """
    m = members.select("pair_id", "node").distinct()
    often = m.groupBy("node").agg(F.count("*").alias("_n"))
    ends = lambda n: often.select(F.col("node").alias(n), F.col("_n").alias(f"_{n}"))
    steps = edges.select("src", "dst").distinct().join(ends("src"), "src").join(ends("dst"), "dst")
    turned = F.col("_src") > F.col("_dst")
    steps = steps.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("_x"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("_y"), turned.alias("_turned"))
    kept = steps.join(m.withColumnRenamed("node", "_x"), "_x").join(m.withColumnRenamed("node", "_y"), ["pair_id", "_y"], "left_semi")
    turned = F.col("_turned")
    kept = saved(kept.select("pair_id", F.when(turned, F.col("_y")).otherwise(F.col("_x")).alias("src"), F.when(turned, F.col("_x")).otherwise(F.col("_y")).alias("dst")), "induced-steps")
    few = edges.join(kept.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return few.join(kept, ["src", "dst"]).select("pair_id", *edges.columns)


def hub_or_isolated(links: DataFrame, member: str, hub: str, members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Hubs to drop: linked to no member or to all of them. links (member, hub), members (member), hubs (hub)."""
    total = members.select(member).distinct().agg(F.count("*").alias("total"))
    reach = links.groupBy(hub).agg(F.count_distinct(member).alias("n"))
    return hubs.select(hub).distinct().join(reach, hub, "left").crossJoin(F.broadcast(total)).filter("n IS NULL OR n >= total").select(hub)  # one row of totals


def differential_hubs(links: DataFrame, member: str, hub: str) -> DataFrame:
    """links without members that reach every hub there is: what all share tells nothing."""
    total = links.agg(F.count_distinct(hub).alias("total"))
    reach = links.groupBy(member).agg(F.count_distinct(hub).alias("n"))
    usual = reach.crossJoin(F.broadcast(total)).filter("n < total").select(member)  # one row of totals
    return links.join(usual, member, "left_semi").select(member, hub).distinct()


def component_filter(members: DataFrame, components: DataFrame, cores: DataFrame) -> DataFrame:
    """members (pair_id, node) that stay: the component with both cores if there is one, else those with any.

    components: pair_id, node, component. cores: pair_id, a, b.
    """
    placed = members.join(components, ["pair_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    own = cores.join(placed.select("pair_id", F.col("node").alias("a"), F.col("component").alias("ca")), ["pair_id", "a"], "left").join(placed.select("pair_id", F.col("node").alias("b"), F.col("component").alias("cb")), ["pair_id", "b"], "left")
    return placed.join(own.select("pair_id", "ca", "cb"), "pair_id").filter("component = ca OR component = cb").select("pair_id", "node")


def rename(df: DataFrame, **names: str) -> DataFrame:
    return reduce(lambda d, kv: d.withColumnRenamed(*kv), names.items(), df)


def top_per(df: DataFrame, by: tuple[str, ...], n: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)
