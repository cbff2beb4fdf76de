"""Whitening against a plain version in exact integers, and on odd vectors."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomgraph.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, _id int, component int, deviation int"


def plain(vectors, k=4):
    """{(id, row): (n, deviation, whitened coordinates, explained)} by Python's integers and one dense matrix."""
    rows = [(i, [floor(256 * float(c)) for c in v]) for i, v in vectors if v is not None and all(c is not None and isfinite(c) for c in v)]
    width = max((len(x) for _, x in rows), default=0)
    rows = [(i, x + [0] * (width - len(x))) for i, x in rows]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda x: [n * c - s for c, s in zip(x, sums, strict=True)]
    if not width:
        return {}
    z = np.array([[float(Fraction(c, n)) for c in centred(x)] for x in fit])
    cov = z.T @ z / n
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1][:k], columns[:, ::-1][:, :k]
    out = []
    for i, x in rows:
        row = np.array([float(Fraction(c, n)) for c in centred(x)])
        out.append((i, n, sum(c * c for c in centred(x)), row @ columns / np.sqrt(values), values / np.trace(cov)))
    return out


def same(got, want, k=4):
    """Rows of the operator against the plain ones; a component's sign is free but the same for all rows."""
    assert len(got) == k * len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    told = {}
    for r in got:
        told.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    signs = np.zeros(k)
    for i, n, deviation, w, explained in sorted(want, key=lambda r: (r[0] is None, r[0] or 0)):
        mine = sorted(told[(i, deviation)], key=lambda r: r["component"])
        assert {r["n"] for r in mine} == {n} and len(mine) % k == 0, key
        v = np.array([m["whitened"] for m in mine]).reshape(k, -1)[:, 0]
        found = np.where(np.abs(w) > 1e-6, np.sign(w * v), 0)
        assert np.all((signs == 0) | (found == 0) | (signs == found))
        signs = np.where(signs == 0, found, signs)
        assert np.allclose(np.abs(v), np.abs(w), atol=1e-8, rtol=1e-8)
        assert np.allclose(np.array([m["explained"] for m in mine]).reshape(k, -1)[:, 0], explained, rtol=1e-10)
    assert all(r["identity_error"] <= 1e-9 for r in got) and len({r["identity_error"] for r in got}) <= 1


def test_query(spark, small):
    rows = pq.read_table(f"{small}/embeddings.parquet").to_pylist()
    same(queries.op11_embedding_whitening(spark, small).collect(), plain([(r["vec_id"], r["embedding"]) for r in rows]))


def test_odd_vectors(spark):
    """Far from the origin, repeated, without an id, of unequal lengths, null and non-finite."""
    rng = np.random.default_rng(3)
    base = [[float(np.float32(1e4 + c)) for c in v] for v in rng.normal(size=(40, 5)) * [1, 2, 3, 4, 5]]
    rows = list(enumerate(base)) + [(100 + i, base[7]) for i in range(30)] + [(7, base[7]), (None, base[3]), (200, base[0][:3]), (201, [])]
    odd = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (303, [float("inf")] * 5)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows + odd], SCHEMA)
    got, want = whitening.whiten(df).collect(), plain(rows)
    assert {r["vec_id"] for r in got} == {i for i, _ in rows}
    assert len({r["n"] for r in got}) == 1 and got[0]["n"] == 42
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], int(r["deviation"])), []).append(abs(r["whitened"]))
    for i, _, deviation, w, _ in want:
        assert np.allclose(sorted(by[(i, deviation)])[: len(w)], sorted(np.abs(w).tolist() * (len(by[(i, deviation)]) // len(w)))[: len(w)], atol=1e-7)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)).collect() == []


def test_flat_directions(spark):
    """One distinct vector, and vectors of one dimension with variance."""
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, 0), (2, [1.0, 2.0], 0, 0, 0, 0)], SCHEMA)).collect()
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, 0.0], 0, 0, 0, 0) for i in range(9)], SCHEMA)).collect()
    assert all(r["whitened"] == 0.0 and r["explained"] == 0.0 for r in line if r["component"] > 1)
    assert all(r["explained"] == 1.0 and r["identity_error"] < 1e-12 for r in line if r["component"] == 1)
    assert len(line) == 27


def test_exact_beyond_a_long():
    """Centred rows and their squares do not lose a unit, whatever their size."""
    x = np.array([[1 << 61, 5], [-(1 << 61), 6]], dtype=np.int64)
    model = whitening.Whitening(3, (7, 1), np.zeros((2, 0)), np.zeros(0), 0.0)
    assert model.deviations(x) == [(3 * (1 << 61) - 7) ** 2 + 14**2, (-3 * (1 << 61) - 7) ** 2 + 17**2]
    wide = whitening.Whitening(1 << 20, (3, -9), np.zeros((2, 0)), np.zeros(0), 0.0)
    y = np.array([[1 << 15, -(1 << 14)]], dtype=np.int64)
    assert wide.deviations(y) == [((1 << 35) - 3) ** 2 + (-(1 << 34) + 9) ** 2]
