"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from memspark.llm import whitening
from memspark.llm.queries import QUERIES, whitening_query


def dense(rows, k, scale=1024, shift=100_000):
    x = np.floor(scale * np.array(rows, dtype=np.float64)).astype(np.int64) + shift
    n, s = len(x), x.sum(axis=0)
    scaled = n * x - s
    c = scaled / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return (scaled**2).sum(axis=1), c @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(got, ids, rows, k):
    deviation, z, explained = dense(rows, k)
    at = {v: i for i, v in enumerate(ids)}
    mine = np.full((len(ids), k), np.nan)
    for r in got:
        i = at[r.vec_id]
        assert r.n == len(ids) and r.deviation == deviation[i] and 0 <= r.identity_error < 1e-8
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        mine[i, r.component - 1] = r.whitened
    assert len(got) == len(ids) * k
    sign = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine - z * sign).max() < 1e-6


def test_the_query_equals_a_dense_solution(spark):
    got = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    table = [r for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect() if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    assert len(table) > 50
    check(got, [r.vec_id for r in table], [r.embedding for r in table], 8)


@pytest.mark.parametrize("spread", [np.ones(100), 0.97 ** np.arange(100), np.repeat([9.0, 1.0], 50)])
def test_close_and_flat_spectra(spread):
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.standard_normal((100, 100)))[0]
    v = (q * (spread * (1 + 0.01 * np.arange(100)[::-1]))) @ q.T
    passes = []
    values, axes, residual = whitening.principal(lambda y: passes.append(1) or v @ y, 100, 8)
    want, vectors = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:8], rtol=1e-12)
    assert np.abs(np.abs((axes * vectors[:, ::-1][:, :8]).sum(axis=0)) - 1).max() < 1e-12
    assert residual.max() < 1e-10 and len(passes) < 200


def test_odd_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r.standard_normal(5) * [4, 3, 2, 1, 0.5]], 1, "s") for i in range(60)]
    bad = [(100, None, 0, ""), (101, [1.0, None, 1.0, 1.0, 1.0], 0, ""), (102, [1.0, float("nan"), 1.0, 1.0, 1.0], 0, ""), (103, [float("inf")] * 5, 0, ""), (104, [], 0, ""), (105, [1.0, 2.0], 0, "")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int, whitened string").repartition(5)
    check(whitening_query(table).collect(), [x[0] for x in rows], [x[1] for x in rows], 5)
    twice = spark.createDataFrame([*rows, rows[3], (None, rows[4][1], 0, "")], "vec_id long, embedding array<double>, n int, whitened string")
    got = whitening_query(twice).collect()
    assert len(got) == 62 * 5 and sum(x.vec_id is None for x in got) == 5 and sum(x.vec_id == 3 for x in got) == 10


def test_no_spread_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert whitening_query(same).collect() == [] and whitening_query(same.limit(0)).collect() == []
    assert whitening_query(same.limit(1)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening_query(line).collect()
    assert [x.component for x in got] == [1] * 5 and abs(got[0].explained - 1) < 1e-12


def test_large_components_keep_exact_deviations(spark):
    rows = [(0, [1e13, 1.0]), (1, [-1e13, 2.0]), (2, [0.5, 1e30])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in whitening.whiten(table, k=2).collect()}
    x = [[int(np.floor(min(max(v * 1024, -(2.0**62)), 2.0**62))) + 100_000 for v in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    for i in range(3):
        want = sum((3 * a - b) ** 2 for a, b in zip(x[i], s, strict=True))
        assert got[i].deviation == (want if want < 10**38 else None)
    assert whitening_query(table).filter("deviation IS NOT NULL").count() == 0
