"""The box hierarchy against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from cellarium.operators import boxes


def table(spark, x, name):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{name} long, x double, y double, z double")


def test_radius_and_nearest(spark, monkeypatch):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 0.02, (250, 3)), rng.uniform(-3, 3, (300, 3)), np.ones((40, 3))])
    q = np.concatenate([rng.uniform(-4, 4, (40, 3)), p[:5], [[1.0, 1.0, 1.0], [50, 0, 0]]])
    monkeypatch.setattr(boxes, "WIDE", 10)  # lower levels are joined by box
    index = boxes.built(table(spark, p, "id"), leaf=4)
    assert index.sizes == [148, 19, 3]
    asked = table(spark, q, "q")
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    radius = F.when(F.col("q") % 3 == 0, 0.0).otherwise(0.9)
    got = {(r.q, r.id): r.d for r in boxes.within(index, asked.withColumn("r", radius)).collect()}
    want = {(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= np.where(np.arange(len(q)) % 3 == 0, 0.0, 0.9)[:, None]))}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    near = {r.q: (r.id, r.d) for r in boxes.nearest(index, asked).collect()}
    assert all(near[i][0] == np.lexsort((np.arange(len(p)), d[i]))[0] and abs(near[i][1] - d[i].min()) < 1e-12 for i in range(len(q)))
    front = boxes.descended(index, asked.select("q", *[F.col(c).alias(f"q{c}") for c in "xyz"], F.lit(0.3).alias("r")), lambda rows: rows.where(boxes.nearest_in_box([F.col(f"q{c}") for c in "xyz"]) <= 0.09))
    assert front.count() < 0.25 * len(q) * index.sizes[0]


def test_one_leaf_and_no_points(spark):
    one = boxes.built(table(spark, np.zeros((1, 3)), "id"))
    asked = table(spark, np.array([[3.0, 4.0, 0.0]]), "q")
    assert [tuple(r) for r in boxes.nearest(one, asked).collect()] == [(0, 0, 5.0)]
    none = boxes.built(table(spark, np.zeros((1, 3)), "id").limit(0))
    assert boxes.nearest(none, asked).count() == 0 and boxes.within(none, asked.withColumn("r", F.lit(9.0))).count() == 0


def test_signed_distance(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.0, 3.0, 0.0), (0.9, 0.0, 0.0), (1.0, 1.0, 1.0)], "x double, y double, z double")
    side = lambda v: [F.lit(v)] * 3
    got = [r.d for r in rows.select(boxes.signed_distance([F.col(c) for c in "xyz"], side(-1.0), side(1.0)).alias("d")).collect()]
    assert np.allclose(got, [-1, 1, np.sqrt(5), -0.1, 0])
