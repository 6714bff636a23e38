"""Derived tables are made anew when what they were made from changes."""

import numpy as np
from pyspark.sql import functions as F

from cellarium.operators import cluster, partition
from cellarium.sources import fixtures, versions


def test_changed_table_under_one_path(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    path = f"{tmp_path}/embeddings.parquet"
    table.write.parquet(path)
    first = {tuple(r) for r in fixtures.neighbours(spark, str(tmp_path)).collect()}
    held = fixtures._kept.tables[spark.sparkContext.applicationId, str(tmp_path)]
    assert {tuple(r) for r in fixtures.neighbours(spark, str(tmp_path)).collect()} == first
    assert fixtures._kept.tables[spark.sparkContext.applicationId, str(tmp_path)] is held  # not made again
    table.withColumn("embedding", F.reverse("embedding")).write.mode("overwrite").parquet(path)
    second = {tuple(r) for r in fixtures.neighbours(spark, str(tmp_path)).collect()}
    assert second != first


def test_topology(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(12, 3))
    cells = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    pairs = [(a, b) for a in range(11) for b in range(a + 1, 11) if rng.random() < 0.4]
    near = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")
    kept = versions.Topology(every=3)
    assert [kept.refresh(cells, near) for _ in range(6)] == [True, False, False, False, True, False]
    assert kept.refresh(cells, near.where("a + b <> 1 and a < 9 and b < 9")) and kept.refresh(cells.where("id < 11"), near)
    kept.refresh(cells, near)
    got = {(r.u, r.v): r.face_weight for r in kept.edges.collect()}
    assert got.keys() == set(pairs) and all(abs(w - ((p[a] - p[b]) ** 2).sum()) < 1e-12 for (a, b), w in got.items())
    extent = {r.id: r.extent for r in kept.extent.collect()}
    for i in range(12):
        d = [np.linalg.norm(p[a] - p[b]) for a, b in pairs if i in (a, b)]
        assert abs(extent[i] - (np.mean(d) / 2 if d else 0)) < 1e-12


def test_fingerprint_sees_rows_and_size(spark):
    rows = spark.range(50).select("id", F.array(F.col("id") * 1.5).alias("feat"))
    one = cluster.fingerprint(rows)
    assert one == cluster.fingerprint(rows.repartition(7)) != cluster.fingerprint(rows.where("id < 49"))
    assert cluster.fingerprint(rows.withColumn("feat", F.when(F.col("id") == 0, F.array(F.lit(9.0))).otherwise(F.col("feat")))) != one


def test_distances_that_are_no_numbers_part_cells(spark):
    rng = np.random.default_rng(2)
    d = [float(v) for v in np.exp(np.concatenate([rng.normal(-3, 0.3, 80), rng.normal(0, 0.3, 80)]))]
    rows = [(i, i + 1, v) for i, v in enumerate([*d, float("nan"), float("inf"), -1.0])]
    got = {r.u: r.w for r in partition.distance_log_odds(spark.createDataFrame(rows, "u long, v long, d double")).collect()}
    assert [got[i] for i in (160, 161, 162)] == [-24.0] * 3 and got[0] > 0 > got[100] and not any(np.isnan(w) for w in got.values())
