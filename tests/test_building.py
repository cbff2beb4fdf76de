"""The graph build as one call against a plain one, its ablations, exports, message passing and running sums."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import building, construction, learning, ordering, relational
from loomgraph.plans import build_queries, catalog, learning_queries
from loomgraph.plans import harness as h
from loomgraph.sources import readers, sinks


def plain_build(t, caps, not_genes):
    """Nodes in order of arrival and edges in build order, from lists of rows."""
    nodes, edges = {}, []

    def node(i, **a):
        for k, v in a.items():
            if v is not None and nodes.setdefault(i, {}).get(k) is None:
                nodes[i][k] = v
        nodes.setdefault(i, {})

    def edge(s, d, kind, source):
        edges.append((s, d, kind, source))

    def genes():
        """Symbols in order: seeds, curated, others."""
        g = [v for v in nodes.values() if v.get("type") == "gene"]
        return [v["symbol"] for v in sorted(g, key=lambda v: {"seed": 0, "curated": 1}.get(v["source"], 2))]

    by = lambda rows, *k: sorted(rows, key=lambda r: tuple(r[c] for c in k))
    for source, rows in (("seed", by(t["seed_pairs"], "seq")), ("curated", by(t["curated"], "seq"))):
        for r in rows:
            for g in (r["a"], r["b"]):
                if g and g not in not_genes:
                    node(f"gene:{g}", type="gene", symbol=g, source=source)
    for r in by(t["seed_pairs"], "seq"):
        edge(f"gene:{r['a']}", f"gene:{r['b']}", "SL_pair", "seed")
        edge(f"gene:{r['b']}", f"gene:{r['a']}", "SL_pair", "seed")
    for r in by(t["curated"], "seq"):
        if r["a"] and r["b"] and not {r["a"], r["b"]} & set(not_genes):
            edge(f"gene:{r['a']}", f"gene:{r['b']}", "SL_pair", "curated")
            edge(f"gene:{r['b']}", f"gene:{r['a']}", "SL_pair", "curated")
    for r in by(t["associations"], "seq"):
        for c in ("a", "b"):
            node(f"gene:{r[c]}", type="gene", symbol=r[c], source="STRING")
        edge(f"gene:{r['a']}", f"gene:{r['b']}", "STRING_association", "STRING")
    acc = {r["gene"]: r["accession"] for r in t["accessions"]}
    known = [(g, acc[g].upper()) for g in genes()[: building.ACCESSION_GENES] if g in acc]
    wanted = {a for _, a in known}
    scope = [r for r in by(t["interactions"], "seq", "source", "target") if r["source"].upper() in wanted or r["target"].upper() in wanted][: caps["interactions"]]
    for r in scope:
        for c in ("source", "target"):
            node(f"protein:{r[c].upper()}", type="protein", accession=r[c].upper(), source="OmniPath")
        edge(f"protein:{r['source'].upper()}", f"protein:{r['target'].upper()}", "OmniPath_interaction", "OmniPath")
    for g, a in known:
        node(f"protein:{a}", type="protein", accession=a, source="OmniPath")
        edge(f"gene:{g}", f"protein:{a}", "encodes", "UniProt/OmniPath")
    have, to = {g.upper() for g in genes()}, {a.upper(): g.upper() for g, a in acc.items()}
    rows = [r for r in t["regulations"] if r["level"] in ("A", "B", "C")]
    chosen = []
    for target in sorted({r["target"] for r in rows}):
        own = sorted((r for r in rows if r["target"] == target), key=lambda r: ("ABCDE".index(r["level"]), r["source"], r["tf"], r["sign"] or ""))
        for place, r in enumerate(own[: caps["tf_per_target"]]):
            tf, tgt = r["tf"].upper(), target.upper()
            if tf not in have and tf in to:
                tf = to[tf]
            if tgt not in have and tgt in to:
                tgt = to[tgt]
            if tgt in have:
                chosen.append((tgt, place, tf, r, "gene" if tf in have else "protein" if r["tf"].upper()[0] in "PQ" else "new"))
    chosen.sort(key=lambda c: (c[0], c[1], c[2]))
    for tgt, _, tf, r, held in chosen[: 300]:
        i = f"protein:{tf}" if held == "protein" else f"gene:{tf}"
        node(i, type="protein" if held == "protein" else "gene", symbol=None if held == "protein" else tf, accession=tf if held == "protein" else None, source="DoRothEA/OmniPath", is_tf=True)
        edge(i, f"gene:{tgt}", "TF_regulates", r["source"] or "DoRothEA/OmniPath")
    cells = {}
    for r in t["effects"]:
        if r["gene"] in set(genes()[:200]) and r["effect"] is not None:
            cells.setdefault(r["gene"], {})[r["cell"]] = r["effect"]
    found = []
    for a, b in itertools.combinations(sorted(cells), 2):
        both = sorted(set(cells[a]) & set(cells[b]))
        if len(both) > 1:
            x, y = [cells[a][c] for c in both], [cells[b][c] for c in both]
            c = np.corrcoef(x, y)[0, 1]
            if not math.isnan(c) and abs(c) >= 0.15:
                found.append((-round(abs(c), 12), a, b))
    for _, a, b in sorted(found)[:30]:
        edge(f"gene:{a}", f"gene:{b}", "DepMap_codependency", "DepMap")
        edge(f"gene:{b}", f"gene:{a}", "DepMap_codependency", "DepMap")
    core = {g for r in t["seed_pairs"] for g in (r["a"], r["b"])}
    for g in genes():
        own = by([r for r in t["pathways"] if r["gene"] == g], "pos")
        for r in own[: 10 if g in core else 3]:
            node(f"pathway:{r['pathway_id']}", type="pathway", name=r["name"], source="Reactome")
            edge(f"gene:{g}", f"pathway:{r['pathway_id']}", "in_pathway", "Reactome")
    now, links = set(genes()), {}
    for r in by(t["drivers"], "seq"):
        if r["gene"] in now:
            links.setdefault(r["tumor"], {}).setdefault(r["gene"], r["seq"])
    for r in sorted(t["cohorts"], key=lambda r: r["cohort"]):
        own = sorted(links.get(r["tumor"], {}).items(), key=lambda kv: (kv[1], kv[0]))
        if own and set(links[r["tumor"]]) < now:
            node(f"cohort:{r['cohort']}", type="cohort", name=r["cohort"], source="IntOGen")
            for g, _ in own[:200]:
                edge(f"gene:{g}", f"cohort:{r['cohort']}", "driver_in", "IntOGen")
    for g in genes():
        for r in by([r for r in t["drugs"] if r["gene"] == g], "pos")[: caps["drug_rows"]]:
            node(f"drug:{r['drug_id']}", type="drug", source="OpenTargets")
            edge(f"drug:{r['drug_id']}", f"gene:{g}", "targets", "OpenTargets")
    return nodes, edges


@pytest.fixture(scope="module")
def tables(spark, small):
    s = build_queries.sources(spark, small)
    return s, {n: [r.asDict() for r in df.collect()] for n, df in vars(s).items() if hasattr(df, "collect")}


def test_build(spark, small, tables):
    s, t = tables
    want, order = plain_build(t, s.caps, s.not_genes)
    nodes = {r["node_id"]: r for r in catalog.QUERIES["built_nodes"](spark, small).collect()}
    assert set(nodes) == set(want)
    for i, w in want.items():
        for c in ("type", "symbol", "name", "accession", "source"):
            assert nodes[i][c] == w.get(c), (i, c)
        assert nodes[i]["is_tf"] == bool(w.get("is_tf")), i
    edges = [(r["src"], r["dst"], r["key"], r["type"], r["source"]) for r in catalog.QUERIES["built_edges"](spark, small).collect()]
    count, keyed = {}, []
    for a, b, kind, source in order:
        count[a, b] = count.get((a, b), -1) + 1
        keyed.append((a, b, count[a, b], kind, source))
    assert sorted(edges) == sorted(keyed)
    assert {"SL_pair", "STRING_association", "encodes", "TF_regulates", "DepMap_codependency", "in_pathway", "targets", "driver_in", "OmniPath_interaction"} == {e[3] for e in edges}


def test_contributions_are_one_for_each_node(spark, tables, monkeypatch):
    """What the steps have told is held as a row for each node, however many rows name it, and genes are numbered anew only after steps that add some."""
    s, _ = tables
    kept = []
    real = building.saved
    monkeypatch.setattr(building, "saved", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    building.build(s)
    held = [df for name, df in kept if name == "build-nodes"]
    assert held and all(df.count() == df.select("node_id").distinct().count() for df in held)
    assert sum(name == "build-genes" for name, _ in kept) == 3


def test_repeated_regulations_count_once(spark):
    """A regulation told twice takes one place among its target's."""
    rows = [("T1", "P1", "A", "x")] * 3 + [("T2", "P1", "A", "x"), ("T3", "P1", "B", "x"), ("T1", "P2", "", "y")]
    got = construction.regulators_per_target(spark.createDataFrame(rows, "tf string, target string, level string, source string"), 2)
    assert [tuple(r) for r in got.select("target", "tf", "rank").collect()] == [("P1", "T1", 1), ("P1", "T2", 2), ("P2", "T1", 1)]


def test_drugs_of_one_place(spark, tables):
    """Of drugs that share their place the first by name are taken, however the rows lie."""
    from dataclasses import replace

    s, _ = tables
    gene = s.seed_pairs.orderBy("seq").first()["a"]
    ids = [f"D{i:02d}" for i in range(40)]
    for order in (ids, ids[::-1]):
        drugs = spark.createDataFrame([(gene, 1, i, 1, "m", "d") for i in order], "gene string, pos long, drug_id string, phase int, mechanism string, disease string").coalesce(1)
        only = replace(s, associations=None, accessions=None, regulations=None, effects=None, pathways=None, cohorts=None, drivers=None, drugs=drugs)
        got = building.build(only).edges.filter("type = 'targets'").select("src").collect()
        assert sorted(r["src"] for r in got) == [f"drug:{i}" for i in ids[:4]]


def test_ablation(tables):
    s, _ = tables
    whole, less = building.build(s), building.build(s, {"depmap", "omnipath"})
    kinds = lambda g: {r["type"] for r in g.edges.select("type").distinct().collect()}
    assert kinds(whole) - kinds(less) == {"DepMap_codependency", "encodes", "OmniPath_interaction"}
    with pytest.raises(ValueError):
        building.build(s, {"none"})


def test_context_stub(tables):
    from dataclasses import replace

    s, _ = tables
    only = {"string", "omnipath", "tf_regulation", "depmap", "reactome", "cancer_driver", "opentargets"}
    stub = replace(s, context_stub=True)
    assert building.build(stub, only).edges.filter("type = 'mutated_in'").count() == 0  # hubs that reach every gene go
    few = building.build(replace(stub, caps={**s.caps, "context_genes": 2}), only).edges.filter("type = 'mutated_in'")
    assert few.count() == 2 * s.cohorts.select("cohort").distinct().count()


def test_mapped_regulations(spark):
    rows = spark.createDataFrame([("p12345", "g1"), ("G2", "Q11111"), ("new", "g1"), ("P99999", "g1"), ("G1", "gone"), ("", "g1")], "tf string, target string")
    genes = spark.createDataFrame([("G1",), ("G2",)], "symbol string")
    acc = spark.createDataFrame([("G2", "P12345"), ("G1", "q11111")], "gene string, accession string")
    got = {(r["tf"], r["target"], r["held"]) for r in building.mapped_regulations(rows, genes, acc).collect()}
    assert got == {("G2", "G1", "gene"), ("NEW", "G1", "new gene"), ("P99999", "G1", "protein")} | {("G2", "G1", "gene")}
    assert {r["held"] for r in building.mapped_regulations(rows, genes, acc, external=False).collect()} == {"gene"}
    assert building.mapped_regulations(rows, genes, None).filter("held = 'protein'").count() == 2


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "gene:A", 0.5), (1, "gene:B<", None), (2, "gene:C", 1.0)], "pair_id int, node string, node_score double")
    edges = spark.createDataFrame([(1, "gene:A", "gene:B<", 0, "x & y", 0.25)], "pair_id int, src string, dst string, key long, type string, evidence double")
    prompts = spark.createDataFrame([(1, "sys", "line one\nline two"), (2, None, "p")], "pair_id int, system string, prompt string")
    sinks.export_pairs(nodes, edges, prompts, str(tmp_path / "out"))
    one = [p for p in (tmp_path / "out/graphml/pair_id=1").iterdir() if p.suffix == ".txt"]
    n, e = readers.graphml(spark, str(one[0]))
    assert len(one) == 1 and {r["node_id"]: r["props"].get("node_score") for r in n.collect()} == {"gene:A": "0.5", "gene:B<": None} and e.first()["props"]["type"] == "x & y"
    assert spark.read.csv(str(tmp_path / "out/nodes"), header=True).count() == 3 and spark.read.csv(str(tmp_path / "out/edges"), header=True).first()["evidence"] == "0.25"
    assert next((tmp_path / "out/prompts/pair_id=1").glob("*.txt")).read_text() == "line one\nline two\n"
    assert [m["role"] for m in json.loads(next((tmp_path / "out/messages/pair_id=1").glob("*.txt")).read_text())] == ["system", "user"]
    sinks.write_graphml(nodes.drop("pair_id").withColumnRenamed("node", "node_id"), edges.drop("pair_id"), str(tmp_path / "whole"))
    (tmp_path / "w.graphml").write_text("".join(p.read_text() for p in sorted((tmp_path / "whole").glob("part-*"))))
    assert readers.graphml(spark, str(tmp_path / "w.graphml"))[0].count() == 3


def test_score_tables(spark, tmp_path):
    rows = spark.createDataFrame([("B", "C", "m", "cove", 0.5), ("A", "B", "m", "cove", 0.25), ("A", "B", "m", "baseline", None), ("A", "B", "m", "naive", 1.0), ("A", "B", "other", "cove", 1.0)], "gene_a string, gene_b string, model string, strategy string, f1_raw double")
    assert sinks.write_model_scores(rows, str(tmp_path), "m") == ["eval_normal_2pairs_m.csv", "eval_naive_1pairs_m.csv"]
    lines = next((tmp_path / "eval_normal_2pairs_m.csv").glob("part-*")).read_text().splitlines()
    assert lines[0].split(",") == sinks.SCORE_COLUMNS and [x.split(",")[:4] for x in lines[1:]] == [["A", "B", "m", "baseline"], ["A", "B", "m", "cove"], ["B", "C", "m", "cove"]]
    more = rows.unionAll(spark.createDataFrame([("X", "Y", "m", "cove", 0.1)], rows.schema))
    assert sinks.write_model_scores(more, str(tmp_path), "m") == ["eval_normal_3pairs_m.csv", "eval_naive_1pairs_m.csv"] and not (tmp_path / "eval_normal_2pairs_m.csv").exists()
    assert sinks.write_model_scores(more, str(tmp_path), "none") == [] and (tmp_path / "eval_naive_1pairs_m.csv").exists()
    assert sinks.update_scores(rows, str(tmp_path / "dry"), dry_run=True) == 5 and not (tmp_path / "dry").exists()


def test_relational_pass(spark, small):
    edges, nodes = h.edges(spark, small).select("src", "dst", "type").collect(), h.nodes(spark, small).collect()
    degree = {r["node_id"]: r["log_degree"] for r in learning.scaled_log_degree(h.edges(spark, small), h.nodes(spark, small)).collect()}
    x = {n["node_id"]: np.array([degree[n["node_id"]], *(1.0 if n["type"] == k else 0.0 for k in ("gene", "drug", "pathway"))]) for n in nodes}
    layer = learning_queries.example_layer()
    gate = np.exp(layer.gates) / np.exp(layer.gates).sum()
    got = {r["node_id"]: r["features"] for r in catalog.QUERIES["relational_pass"](spark, small).collect()}
    assert set(got) == set(x)
    into = {}
    for s, d, t in edges:
        into.setdefault((d, t), []).append(x[s])
    for n, own in x.items():
        total = own @ layer.root + layer.bias
        for i, t in enumerate(layer.relations):
            if (n, t) in into:
                w = sum(layer.coefficients[i, k] * layer.bases[k] for k in range(len(layer.bases)))
                total = total + gate[i] * (np.mean(into[n, t], axis=0) @ w)
        out = np.maximum(total, 0) + own
        out = (out - out.mean()) / math.sqrt(out.var() + relational.EPSILON)
        assert np.allclose(got[n], out, atol=2e-6)


def test_pair_scores(spark):
    r = np.random.default_rng(3)
    v = {i: r.normal(size=3) for i in range(6)}
    features = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in v.items()], "node_id int, features array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 5)], "a int, b int")
    layers = [(r.normal(size=(9, 4)), r.normal(size=4)), (r.normal(size=(4, 1)), r.normal(size=1))]
    got = {(x["a"], x["b"]): x["score"] for x in relational.pair_scores(pairs, features, layers).collect()}
    for (a, b), s in got.items():
        z = np.maximum(np.concatenate((v[a] + v[b], v[a] * v[b], abs(v[a] - v[b]))) @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
        assert s == pytest.approx(1 / (1 + math.exp(-z[0])))
    assert got[0, 1] == pytest.approx(got[1, 0]) and len(got) == 3


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(40)]), i, r.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, n int")
    got = ordering.running_sums(df, [F.desc("k"), F.col("i")], s=F.col("n"), place=F.lit(1)).collect()
    total = 0
    for place, (row, want) in enumerate(zip(sorted(got, key=lambda x: x["place"]), sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1])), strict=True), 1):
        total += want[2]
        assert (row["i"], row["s"], row["place"]) == (want[1], total, place)
    assert ordering.running_sums(df.limit(0), [F.col("k")], s=F.col("n")).count() == 0
