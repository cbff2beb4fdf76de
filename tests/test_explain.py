"""Whole explanations against a plain search on the smallest tables, and the node caps on random graphs."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from loomgraph.functions import scalars
from loomgraph.operators import pagerank, subgraph
from loomgraph.plans import catalog, explain
from loomgraph.plans import harness as h
from tests import dense


class Plain:
    """A multigraph held in dictionaries."""

    def __init__(self, edges, kinds):
        self.edges, self.kinds = edges, kinds  # (src, dst, key, type, source, evidence)
        self.near, self.best = {}, {}
        for s, d, _, _, _, e in edges:
            link = frozenset((s, d))
            self.best[link] = max(self.best.get(link, 0.0), e)
            if s != d:
                self.near.setdefault(s, set()).add(d)
                self.near.setdefault(d, set()).add(s)

    def ball(self, start, hops):
        seen = frontier = {start}
        for _ in range(hops):
            frontier = {m for n in frontier for m in self.near.get(n, ())} - seen
            seen = seen | frontier
        return seen

    def hops(self, cores, most):
        return {n: min(i for i in range(most + 1) for c in cores if n in self.ball(c, i)) for n in set().union(*(self.ball(c, most) for c in cores))}

    def drop_genes(self, kept, cores, path, cap, passes, flags=frozenset()):
        kept = set(kept)
        for _ in range(passes):
            changed = False
            for a in sorted(kept):
                if a not in kept:
                    continue
                genes = [n for n in self.near.get(a, ()) if n in kept and n not in cores and self.kinds.get(n) == "gene" and n not in flags]
                genes.sort(key=lambda n: (n not in path, -self.best[frozenset((a, n))], n))
                for n in genes[cap:]:
                    kept.discard(n)
                    changed = True
            if not changed:
                break
        return kept

    def core_caps(self, kept, cores, path, cap, tf_cap, least, step, flags=frozenset()):
        kept = set(kept)
        for a in sorted(cores):
            genes = {n for n in self.near.get(a, ()) if n in kept and n not in cores and self.kinds.get(n) == "gene"}
            drugs = {s for s, d, _, t, o, _ in self.edges if d == a and t == "targets" and o == "OpenTargets" and self.kinds.get(s) == "drug"}
            limit = cap if cap <= 0 else max(least, cap - len(drugs) // step)
            tfs = {n for n in genes if n in flags or any(t == "TF_regulates" and {s, d} == {a, n} for s, d, _, t, _, _ in self.edges)}
            for some, c in ((genes - tfs, limit), (tfs, tf_cap)):
                must = {n for n in some if n in path}
                extras = sorted(some - must, key=lambda n: (-self.best[frozenset((a, n))], n))
                kept -= set(extras[max(0, max(c, len(must)) - len(must)) :])
        return kept


def explained(g, a, b, paths, near=1.0, far=0.4, cap=4, passes=6):
    """Nodes and edges of one pair's explanation."""
    cores, path = {a, b}, {n for p in paths for n in p}
    functions = {d for s, d, _, t, _, _ in g.edges if s in cores and t == "in_pathway" and g.kinds[d] == "pathway"}
    protected = cores | path | functions
    dist = g.hops(cores, 2)
    kept = {n for n in g.ball(a, 2) | g.ball(b, 2) | protected if n in protected or dist.get(n, 9) <= 1}
    kept = g.drop_genes(kept, cores, path, cap, passes)
    inner = [e for e in g.edges if e[0] in kept and e[1] in kept]
    must = set()
    for p in paths:
        for x, y in zip(p, p[1:], strict=False):
            must.add(min((e for e in inner if {e[0], e[1]} == {x, y}), key=lambda e: (-e[5], e[0], e[1], e[2]))[:3])
    free = [e for e in inner if e[:3] not in must]
    stay = set()
    for c in cores:  # a cap of -1 leaves the last one out, as slicing does
        into = sorted((e[0] for e in free if e[1] == c), key=str)
        stay |= set(into[:-1])
    free = [e for e in free if g.kinds.get(e[0]) != "drug" or e[0] in stay or e[0] in path]
    order = lambda e: (-e[5], e[0], e[1], e[2])
    at = sorted((e for e in free if e[0] in cores or e[1] in cores), key=order)
    off = sorted((e for e in free if not (e[0] in cores or e[1] in cores)), key=order)
    chosen = at[: math.floor(len(at) * near)] + off[: math.floor(len(off) * far)] + [e for e in inner if e[:3] in must]
    links, best = {}, {}
    for s, d, _, _, _, e in chosen:
        links.setdefault(s, set()), links.setdefault(d, set())
        if s != d:
            links[s].add(d)
            links[d].add(s)
            best[frozenset((s, d))] = max(best.get(frozenset((s, d)), 0.0), e)
    for _ in range(passes):
        changed = False
        for n in sorted(links):
            genes = sorted((m for m in links[n] if g.kinds[m] == "gene"), key=lambda m: (m not in cores, m not in path, -best[frozenset((n, m))], m))
            for m in genes[cap:]:
                links[n].discard(m)
                links[m].discard(n)
                changed = True
        if not changed:
            break
    chosen = [e for e in chosen if e[0] == e[1] or e[1] in links[e[0]]]
    ends = {n for e in chosen for n in e[:2]}
    kept = {n for n in kept if n in cores or n in ends}

    def part(start):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for e in chosen:
                for y, z in ((e[0], e[1]), (e[1], e[0])):
                    if y == x and z not in seen:
                        seen.add(z)
                        todo.append(z)
        return seen

    whole = part(a) | part(b)
    kept &= whole
    chosen = [e for e in chosen if e[0] in kept and e[1] in kept]
    return kept, {e[:3] for e in chosen}, path, dist


def test_explanations_against_search(spark, small):
    edges = h.edges(spark, small).select("src", "dst", "key", "type", "source", "evidence")
    rows = [tuple(r) for r in edges.collect()]
    kinds = {r["node_id"]: r["type"] for r in h.nodes(spark, small).collect()}
    g = Plain(rows, kinds)
    told = explain.explain(h.nodes(spark, small), edges, h.pairs(spark, small), explain.Settings(priority=h.PRIORITY))
    paths = {}
    for r in told.paths.collect():
        paths.setdefault(r["pair_id"], []).append(list(r["nodes"]))
    nodes = told.nodes.toPandas()
    links = told.edges.toPandas()
    names = sorted({n for r in rows for n in r[:2]})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for s, d, *_ in rows:
        m[at[s], at[d]] += 1
    rank = dense.green(m)
    rank /= rank.sum(axis=1, keepdims=True)
    for p in h.pairs(spark, small).collect():
        i, a, b = p["pair_id"], p["a"], p["b"]
        kept, chosen, path, dist = explained(g, a, b, paths.get(i, []))
        own = nodes[nodes["pair_id"] == i].set_index("node")
        assert set(own.index) == kept, i
        assert {tuple(x) for x in links[links["pair_id"] == i][["src", "dst", "key"]].itertuples(index=False)} == chosen
        for n, r in own.iterrows():
            assert r["role"] == ("core" if n in (a, b) else "path" if n in path else "other") and r["core_dist"] == dist.get(n, 4)
            assert r["ppr_a"] == pytest.approx(rank[at[a], at[n]], abs=1e-6) and r["ppr_b"] == pytest.approx(rank[at[b], at[n]], abs=1e-6)
            assert r["evidence_to_cores"] == pytest.approx(max([g.best.get(frozenset((n, c)), 0.0) for c in (a, b)]))
        parts = {"dist": 1 - own["core_dist"] / own["core_dist"].max(), "evidence": own["evidence_to_cores"], "ppr": own["ppr_max"], "prob": own["prob_max"], "necessity": own["necessity_score"]}
        weights = {**{k: w for k, w in scalars.NODE_WEIGHTS.items() if k != "semantic"}, "necessity": scalars.NECESSITY_WEIGHT}
        want = sum(weights[k] * parts[k].clip(0, 1) for k in parts) / sum(weights.values())
        assert np.allclose(own["node_score"], want.clip(0, 1))


def test_registered_explanations_agree(spark, small):
    nodes = catalog.QUERIES["explained_nodes"](spark, small).toPandas()
    edges = catalog.QUERIES["explained_edges"](spark, small).toPandas()
    ends = pd.concat([edges[["pair_id", "src"]].set_axis(["pair_id", "node"], axis=1), edges[["pair_id", "dst"]].set_axis(["pair_id", "node"], axis=1)])
    have = set(nodes[["pair_id", "node"]].itertuples(index=False, name=None))
    assert set(ends.itertuples(index=False, name=None)) <= have and len(have) == len(nodes)


def random_graph(seed):
    r = random.Random(seed)
    n = r.randrange(8, 30)
    kinds = {f"n{i:02d}": r.choice(["gene", "gene", "gene", "drug", "pathway"]) for i in range(n)}
    kinds["n00"] = kinds["n01"] = "gene"
    types = [("STRING", "S"), ("TF_regulates", "T"), ("targets", "OpenTargets"), ("targets", "x")]
    edges = []
    for k in range(r.randrange(15, 120)):
        s, d = r.sample(sorted(kinds), 2)
        edges.append((s, d, k, *r.choice(types), round(r.random(), 1)))
    return Plain(edges, kinds), {x for x in kinds if r.random() < 0.1}, {x for x in kinds if r.random() < 0.15}


@pytest.mark.parametrize("cap", [0, 1, 3])
def test_node_caps_against_search(spark, cap):
    graphs = {i: random_graph(100 * cap + i) for i in range(25)}
    name = lambda i, n: f"{i:02d}:{n}"
    edges = spark.createDataFrame([(name(i, s), name(i, d), k, t, o, e) for i, (g, _, _) in graphs.items() for s, d, k, t, o, e in g.edges], "src string, dst string, key int, type string, source string, evidence double")
    facts = [(i, name(i, n), kind, n in ("n00", "n01"), n in path, n in flags) for i, (g, flags, path) in graphs.items() for n, kind in g.kinds.items()]
    nodes = spark.createDataFrame(facts, "pair_id int, node string, type string, core boolean, on_path boolean, is_tf boolean")
    told = {}
    for r in subgraph.node_gene_caps(nodes, edges, cap, 6).collect():
        told.setdefault(r["pair_id"], set()).add(r["node"].split(":")[1])
    early = {}
    for r in subgraph.core_gene_caps(nodes, edges, cap + 1, cap, least=1, step=1).collect():
        early.setdefault(r["pair_id"], set()).add(r["node"].split(":")[1])
    for i, (g, flags, path) in graphs.items():
        cores = {"n00", "n01"}
        assert told[i] == g.drop_genes(set(g.kinds), cores, path, cap, 6, flags), i
        assert early[i] == g.core_caps(set(g.kinds), cores, path, cap + 1, cap, 1, 1, flags), i
