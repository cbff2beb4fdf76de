"""Readers, sinks, caches, merges, resuming."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import construction, evaluation, learning, models, strategies
from loomgraph.sources import readers, sinks
from loomgraph.streaming import resume


def test_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([("gene:A", "Gene", None, ["x", "y"]), ("gene:B<", "gene", "b & c", None)], "node_id string, type string, name string, terms array<string>")
    edges = spark.createDataFrame([("gene:A", "gene:B<", 0, "SL_pair", "seed"), ("gene:A", "gene:B<", 1, "x", None)], "src string, dst string, key long, type string, source string")
    (tmp_path / "g.graphml").write_text("\n".join(r["line"] for r in sinks.graphml_rows(nodes, edges).orderBy("part", "place").collect()))
    n, e = readers.graphml(spark, str(tmp_path / "g.graphml"))
    got = {r["node_id"]: (r["type"], r["props"]) for r in n.collect()}
    assert got["gene:A"] == ("gene", {"type": "Gene", "terms": '["x","y"]'}) and got["gene:B<"][1]["name"] == "b & c"
    assert sorted((r["src"], r["dst"], r["key"], r["type"], r["source"]) for r in e.collect()) == [("gene:A", "gene:B<", "0", "SL_pair", "seed"), ("gene:A", "gene:B<", "1", "x", None)]


def test_tables(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"gene_a": "A", "gene_b": "B"}, {"gene_a": "-", "gene_b": "B"}, {"gene_a": "C", "gene_b": None}]))
    raw = readers.json_array(spark, str(tmp_path / "p.json"), "gene_a string, gene_b string")
    assert [tuple(r) for r in construction.curated_pairs(raw).collect()] == [("A", "B", 0)]
    (tmp_path / "m.csv").write_text("id,ACH-1,ACH-2\nTP53 (1),1.5,\nKRAS (2),2,3\n")
    assert sorted(tuple(r) for r in readers.effect_matrix(spark, str(tmp_path / "m.csv")).filter("effect IS NOT NULL").collect()) == [("ACH-1", "KRAS", 2.0), ("ACH-1", "TP53", 1.5), ("ACH-2", "KRAS", 3.0)]
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\n2\tx\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "t.tsv"), 1).collect()] == [("1", "")]
    assert readers.json_or_empty(spark, str(tmp_path / "none"), "k string").count() == 0
    df = spark.createDataFrame([(1, None, " ", "none")], "a int, b string, c string, d string")
    assert sinks.nonempty_columns(df) == ["a"]
    sinks.write_csv(df.select("a"), str(tmp_path / "out"), ["z", "a"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["z", "a"]
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "out2"), ["a"])
    sinks.replace_table(df, str(tmp_path / "tab"))
    sinks.replace_table(df.unionAll(df), str(tmp_path / "tab"))
    assert spark.read.parquet(str(tmp_path / "tab")).count() == 2


def test_payload_names(spark):
    df = spark.createDataFrame([("d/KRAS_SNRPD3_naive_m_1.json",), ("KRAS_SNRPD3_m_1.json",), ("x.json",)], "p string")
    assert [r[0] for r in df.select(evaluation.model_of(F.col("p"))).collect()] == ["m_1", "m_1", None]
    rows = evaluation.payload_rows(spark.createDataFrame([("A_B_m.json", "{broken"), ("A_B_m.json", '{"metrics": {"prompt": {}, "cove": {"feature_embed_f1_raw": 0.5, "checks": {"citation_count": 2}}}}')], "path string, content string"))
    assert [(r["strategy"], r["f1_raw"], r["citation_count"]) for r in rows.collect()] == [("cove", 0.5, 2.0)]


def test_strategies(spark):
    df = spark.createDataFrame([(1, "Say why."), (2, None)], "id int, prompt string")
    for run in strategies.STRATEGIES.values():
        out = run(df)
        assert out.count() == 2 and {"initial", "final"} <= set(out.columns)
        assert [tuple(r) for r in out.orderBy("id").collect()] == [tuple(r) for r in run(df).orderBy("id").collect()]
    assert models.strip_reasoning("<think>a</think> b") == "b" and models.parse_generated_phrases("1) a; b, A") == ["a", "b"]


def test_calibration(spark):
    raw = spark.createDataFrame([("a", 0.20), ("b", 0.25), ("c", 0.30), ("d", 0.25)], "name string, value double")
    got = {r["name"]: r["weight"] for r in learning.calibrated(raw).collect()}
    assert got == pytest.approx({"a": 0.0652, "b": 0.5050, "c": 0.9448, "d": 0.5050})
    flat = raw.withColumn("value", F.lit(1.0))
    assert {r["weight"] for r in learning.calibrated(flat, method="minmax").collect()} == {1.0}
    with pytest.raises(ValueError):
        learning.calibrated(raw, method="x")
    with pytest.raises(ValueError):
        learning.assert_no_leak(spark.createDataFrame([("SL_pair",)], "type string"))


def test_resume(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        resume.run_available(spark, src, "id long", lambda b: b.withColumn("x", F.col("id") * 2), out, cp)
    spark.range(3, 5).write.mode("append").parquet(src)
    resume.run_available(spark, src, "id long", lambda b: b.withColumn("x", F.col("id") * 2), out, cp)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_small_files(spark, tmp_path):
    sinks.save_json({"a": [1]}, str(tmp_path / "x.json"))
    assert readers.load_json(str(tmp_path / "x.json"), None) == {"a": [1]} and readers.load_json(str(tmp_path / "none"), 7) == 7
    (tmp_path / "bad.json").write_text("{")
    assert readers.load_json(str(tmp_path / "bad.json"), 7) == 7 and len(list(tmp_path.iterdir())) == 2
    (tmp_path / "a.tsv").write_text("x\ty\nA\tB\nC\tD\n")
    (tmp_path / "b.tsv").write_text("n\ttarget\tsource\n1\tB\tA\n")
    assert [tuple(r)[:2] for r in readers.interactions(spark, str(tmp_path / "a.tsv")).orderBy("seq").collect()] == [("A", "B"), ("C", "D")]
    assert [tuple(r)[:2] for r in readers.interactions(spark, str(tmp_path / "b.tsv")).collect()] == [("A", "B")]


def test_prompts(spark, tmp_path):
    for name, kind, content in (("A_B", "messages.json", json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "u"}])), ("A_B", "prompt.txt", "other"), ("C_D", "prompt.txt", "plain"), ("E_F", "messages.json", "{broken")):
        (tmp_path / "p" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name / kind).write_text(content)
    got = {r["id"]: (r["system"], r["prompt"]) for r in evaluation.prompt_parts(readers.prompts(spark, str(tmp_path / "p")), "any").collect()}
    assert got["A_B"] == ("s", "u") and got["C_D"] == (None, "plain") and "E_F" not in got


def test_wide_matrix(spark, tmp_path):
    """Twenty thousand columns are planned at once, quoted names and odd values included, either way round."""
    import time

    names = [f"G{i} ({i})" for i in range(20_000)]
    rows = [[f"ACH-{c}", *(f"{c + i / 8}" for i in range(20_000))] for c in range(3)]
    rows[1][1:7] = ["", "NA", "-1.5e-3", "+.5", "7.", "x1"]
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    names[2] = 'odd, "name" here'
    wide = tmp_path / "wide.csv"
    wide.write_text("\n".join([",".join(["", *map(quoted, names)]), *(",".join(r) for r in rows)]) + "\n")
    began = time.time()
    df = readers.effect_matrix(spark, str(wide))
    plan = df._jdf.queryExecution().toString()
    assert time.time() - began < 10 and len(plan) < 50_000
    got = {(r["cell"], r["gene"]): r["effect"] for r in df.collect()}
    assert len(got) == 60_000 and got["ACH-0", "G8"] == 1.0 and got["ACH-2", "odd,"] == 2.25
    assert [got["ACH-1", g] for g in ("G0", "G1", "odd,", "G3", "G4", "G5")] == [None, None, -0.0015, 0.5, 7.0, None]
    turned = tmp_path / "turned.csv"
    turned.write_text("gene,ACH-1,ACH-2\nKRAS (1),1,2\n\nTP53 (2),3\n")
    assert sorted(tuple(r) for r in readers.effect_matrix(spark, str(turned)).collect()) == [("ACH-1", "KRAS", 1.0), ("ACH-1", "TP53", 3.0), ("ACH-2", "KRAS", 2.0)]
    (tmp_path / "none.csv").write_text("")
    assert readers.effect_matrix(spark, str(tmp_path / "none.csv")).count() == 0
