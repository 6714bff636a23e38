"""Operator 11 against numpy on the same entries."""

import math

import numpy as np
import pytest

from cellarium.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string"


def quantised(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], dtype=object)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    scale = np.array([3, 1, 0.5, 0.2, 2, 0.7, 0.05, 1.5, 0.9, 0.3])
    return [(k, [float(c) for c in v], 7, "n") for k, v in enumerate(rng.normal(size=(300, 10)) * scale + np.arange(10))]


ODD = [(900, None, 1, "a"), (901, [1.0, None] + [0.0] * 8, 1, "b"), (902, [float("nan")] * 10, 1, "c"), (903, [float("inf")] * 10, 1, "d"), (904, [], 1, "e")]


def test_whitened_equals_numpy(spark, rows, tmp_path):
    given = [*rows, rows[0], (None, rows[1][1], 0, None)]
    spark.createDataFrame(given + ODD, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op11_whitening(spark, str(tmp_path))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = found.collect()
    x = quantised([r[1] for r in given])
    n, s = len(given), x.sum(axis=0)
    cov = np.cov((x - x.min()).astype(float), rowvar=False, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert len(got) == 8 * n and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    want = ((x - 100_000).astype(float) - (x - 100_000).astype(float).mean(axis=0)) @ vectors / np.sqrt(values)
    sign = {}
    for r in got:
        k = [i for i, g in enumerate(given) if g[0] == r.vec_id][0]
        assert r.deviation == sum(int(n * a - b) ** 2 for a, b in zip(x[k], s, strict=True))
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
        w = want[k, r.component - 1]
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(r.whitened) - abs(w)) < 1e-8
    assert sum(r.vec_id is None for r in got) == 8 and sum(r.vec_id == 0 for r in got) == 16


def test_several_aggregations_give_the_same(spark, rows, monkeypatch):
    given = spark.createDataFrame(rows, SCHEMA)
    whole = {r.id: r.whitened for r in whitening.whiten(given).collect()}
    monkeypatch.setattr(whitening, "PAIRS", 7)
    for r in whitening.whiten(given).collect():
        assert np.abs(np.abs(r.whitened) - np.abs(whole[r.id])).max() < 1e-9


def test_lengths_zero_variance_and_huge_entries(spark):
    flat = [(k, [1.0, 2.0 * (k % 2), 5.0], 0, "") for k in range(6)]  # one dimension varies
    other = [(10 + k, [float(k), float(k * k)], 0, "") for k in range(4)]
    got = {r.id: r for r in whitening.whiten(spark.createDataFrame(flat + other + [(99, [3.0], 0, "")], SCHEMA)).collect()}
    assert set(got) == {*range(6), *range(10, 14)}  # a single vector of its length has no component
    assert len(got[0].whitened) == 1 and abs(abs(got[0].whitened[0]) - 1) < 1e-12 and got[0].explained == [1.0]
    assert len(got[10].whitened) == 2 and got[10].n == 4
    huge = spark.createDataFrame([(1, [3e38, 0.0], 0, ""), (2, [-3e38, 1.0], 0, ""), (3, [0.0, 2.0], 0, "")], SCHEMA)
    got = whitening.whiten(huge).collect()
    assert {r.deviation for r in got} >= {None} and all(math.isfinite(v) for r in got for v in r.whitened)


def test_empty_tables(spark):
    for given in ([], ODD):
        assert whitening.whiten(spark.createDataFrame(given, SCHEMA)).collect() == []
