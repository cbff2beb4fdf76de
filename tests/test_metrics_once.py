"""Models that are asked once for what several metrics read."""

from loomgraph.operators import judging


def test_phrases_are_extracted_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    class Noted:
        def extract(self, text):
            with open(log, "a") as f:
                f.write("x\n")
            return ["protein kinase"]

    rows = spark.createDataFrame([("a", "A protein kinase binds.", "", ["protein kinase"], "It binds.")], "id string, text string, context string, features array<string>, explanation string")
    got = judging.text_metrics(rows, extractor=Noted()).collect()
    assert len(got) == 1 and len(open(log).readlines()) == 1
