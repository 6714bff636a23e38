"""Every shared query against the oracle engine at the smallest scale, and sequential operators against plain code."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cellarium.operators import cluster, partition
from cellarium.plans.queries import REGISTRY
from cellarium.sources.fixtures import TABLES
from cellarium.sources.readers import decode_rle
from cellarium.streaming import tracker

SF = "/root/testdata/sf0.001"
SLOW = {"connected_components", "threshold_components", "split_connected"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    fix = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, (int, np.integer)) else str(v)
    return sorted((tuple(map(fix, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_query_equals_oracle(spark, duck, name):
    q = REGISTRY[name]
    got, want = q.run(spark, SF).toPandas(), duck.execute(q.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def naive_contract(edges):
    comp = {n: n for e in edges for n in e[:2]}
    while True:
        sums = {}
        for u, v, w in edges:
            a, b = sorted((comp[u], comp[v]))
            if a != b:
                sums[a, b] = sums.get((a, b), 0) + w
        best = max(sums.items(), key=lambda x: x[1], default=None)
        if best is None or best[1] <= 0:
            return comp
        a, b = best[0]
        comp = {n: a if c == b else c for n, c in comp.items()}


def test_contraction_equals_plain_code():
    rng = np.random.default_rng(1)
    for _ in range(30):
        edges = [(u, v, float(rng.normal(0.1))) for u in range(9) for v in range(u + 1, 9) if rng.random() < 0.5]
        got = dict(partition.contract(pd.DataFrame(edges, columns=["u", "v", "w"])).itertuples(index=False, name=None))
        want = naive_contract(edges)
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a in want for b in want)


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 0.05, (30, 3)), rng.normal(3, 0.05, (30, 3)), rng.uniform(-6, 9, (8, 3))])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {r.id: r.cluster for r in cluster.dbscan(df, 0.5, 5).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 60)} == {30}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    core = {i for i in range(len(p)) if (d[i] <= 0.5).sum() >= 5}
    assert all((got[i] is None) == (not any(j in core and d[i, j] <= 0.5 for j in range(len(p)))) for i in got)


def test_rle_round_trip(spark):
    masks = REGISTRY["rle_encode"].run(spark, SF)
    from cellarium.sources.fixtures import fixture

    assert rows(decode_rle(masks).toPandas()) == rows(fixture(spark, SF, "mask_pixels").toPandas())


def test_tracker_steps():
    frames = [(1, f, o, 1.0 - o / 10) for f, seen in enumerate([[1, 2], [1, 3], [1], [1], [2]]) for o in seen]
    out, tracks, following = tracker.step(1, pd.DataFrame(frames, columns=["scene", "frame", "object", "score"]), {}, 0, 2, 2)
    assert [(f, o, e) for _, f, o, _, e in out] == [(0, 1, "promoted"), (0, 2, "promoted"), (1, 3, "dropped"), (3, 2, "stale"), (4, 2, "promoted")]
    assert following == 3 and tracks[2] == (2, 4)


def test_frame_upsert(spark, tmp_path):
    schema = "frame long, segment long, payload string"
    spark.createDataFrame([(0, 0, "a"), (10, 0, "old"), (10, 1, "new")], schema).write.parquet(f"{tmp_path}/in")
    tracker.upsert_frames(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert {(r.frame, r.payload) for r in tracker.read_frames(spark, f"{tmp_path}/out").collect()} == {(0, "a"), (10, "new")}


def test_distance_mixture_runs_to_the_operators_end(spark):
    from cellarium.plans.queries import _edges

    x = np.log([r.d + 1e-6 for r in _edges(spark, SF).select("d").collect()])
    parts = [(0.5, m, x.std() / 2 + 1e-6) for m in np.quantile(x, [0.1, 0.9])]
    for _ in range(60):
        dens = [w / s * np.exp(-((x - m) ** 2) / (2 * s * s)) for w, m, s in parts]
        shares = [p / sum(dens) for p in dens]
        parts = [(r.mean(), (r * x).sum() / r.sum(), ((r * x * x).sum() / r.sum() - ((r * x).sum() / r.sum()) ** 2) ** 0.5 + 1e-6) for r in shares]
    got = REGISTRY["distance_mixture"].run(spark, SF).collect()
    assert [tuple(r) for r in got] == [pytest.approx(p, abs=1e-5) for p in sorted(parts, key=lambda p: p[1])]
