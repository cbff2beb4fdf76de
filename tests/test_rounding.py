"""Queries and SQL that round the same numbers."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from loomgraph.plans import catalog

#: The first component of this vector at unit length is 0.9151282884999999, which times 1e9 is a half.
NEAR = [-1.7954299449920654, 0.7909825444221497]


def test_unit_vectors_near_a_half(spark, tmp_path):
    vectors = [NEAR, [3.0, 4.0], [0.0, 0.0], [], None]
    pq.write_table(pa.table({"vec_id": range(len(vectors)), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), tmp_path / "embeddings.parquet")
    got = {r["vec_id"]: (r["unit"], r["squashed"]) for r in catalog.QUERIES["unit_vectors"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert got == {i: (u, s) for i, u, s in c.execute(catalog.SQL["unit_vectors"]).fetchall()}
    assert got[0][0][0] == -0.915128288 and got[1][0] == [0.6, 0.8] and got[2][0] == [0.0, 0.0] and got[3][0] == []
