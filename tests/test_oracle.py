"""Every query with SQL against DuckDB on the smallest tables, and every other one for a stable schema."""

import duckdb
import numpy as np
import pytest

from loomgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if isinstance(x, np.ndarray | list):
            return tuple(plain(y) for y in x)
        if x is None or isinstance(x, float | np.floating) and x != x or str(x) in ("<NA>", "NaT"):
            return None
        return x.item() if isinstance(x, np.generic) else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(duck.execute(catalog.SQL[name]).fetchdf())
    else:
        assert len(got.columns) > 1
