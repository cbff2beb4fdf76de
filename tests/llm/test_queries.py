"""The registered queries on the smallest tables: SQL where there is some, the pipeline, and the entry without this subpackage."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from loomgraph.llm import queries
from tests.conftest import ROOT
from tests.test_oracle import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, small).toPandas()
    if name in queries.SQL:
        assert rows(got) == rows(c.execute(queries.SQL[name]).fetchdf())
    elif name == "op11_embedding_whitening":
        assert len(got) == 4 * c.execute("SELECT count(*) FROM embeddings").fetchall()[0][0]
    else:
        assert len(got) == c.execute("SELECT count(*) FROM documents").fetchall()[0][0]


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), small).count() == 0
        docs = out
    last = corpus_pipeline.run(spark, small)
    assert last.count() == docs.count() > 0 and last.filter("n_tokens <> size(ids)").count() == 0
    assert set(__spark_entry__.queries()) >= {*queries.QUERIES, "pipeline"}


def test_entry_stands_alone(tmp_path):
    import shutil

    for p in ("__spark_entry__.py", "loomgraph"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "loomgraph" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
