"""Ranks that settle slowly."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from loomgraph.plans import catalog


def test_node_features_of_a_ring(spark, tmp_path):
    """Rank that enters a ring goes round it; 0.85 of it is left after each step, so two dozen steps leave a fiftieth. Most nodes have no edges."""
    n = 40
    pq.write_table(pa.table({"s_suppkey": range(n), "s_name": [f"s{i}" for i in range(n)]}), tmp_path / "supplier.parquet")
    pq.write_table(pa.table({"p_partkey": range(n), "p_name": [f"p{i}" for i in range(n)], "p_size": range(n)}), tmp_path / "part.parquet")
    ring = [x for i in range(8) for x in ((i, i, "O"), (i, (i + 1) % 8, "F"))] + [(0, s, "O") for s in range(8, 12)]
    lines = [(o, *x) for o, x in enumerate(ring)]
    table = {"l_orderkey": [x[0] for x in lines], "l_linenumber": [x[0] % 7 for x in lines], "l_partkey": [x[1] for x in lines], "l_suppkey": [x[2] for x in lines], "l_linestatus": [x[3] for x in lines], "l_returnflag": ["A"] * 20}
    pq.write_table(pa.table(table | {c: [1.0 + x[0] for x in lines] for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}), tmp_path / "lineitem.parquet")
    got = {r["node_id"]: list(r["features"]) for r in catalog.QUERIES["node_features"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    for t in ("supplier", "part", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert len(got) == 2 * n and got == dict(c.execute(catalog.SQL["node_features"]).fetchall())
