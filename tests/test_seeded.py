"""The keyed generator and what is drawn with it, against plain 32-bit code."""

import math

import numpy as np
from pyspark.sql import functions as F

from cellarium.functions import scalar
from cellarium.operators import masks, seeded

M = 0xFFFFFFFF


def mix(x):
    for s, k in scalar.MIX:
        x = (x ^ x >> s) * k & M
    return x ^ x >> 14


def test_numbers(spark):
    keys = [0, 1, 2, 12345, M - 1, M, 1 << 40]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", scalar.seeded(F.col("k")).alias("a"), scalar.following(scalar.seeded(F.col("k"))).alias("b"), scalar.below(scalar.seeded(F.col("k")), F.lit(7)).alias("c"), scalar.normal(scalar.seeded(F.col("k"))).alias("g"))
    for r in rows.collect():
        a = mix((r.k & M) ^ 0x2815DB5B)
        b = mix(a + 1 & M)
        assert (r.a, r.b, r.c) == (a, b, min(a // (M // 7), 6))
        assert abs(r.g - math.sqrt(-2 * math.log(max(a / M, 1.1754943508222875e-38))) * math.cos(2 * math.pi * b / M)) < 1e-12


def test_draws_look_uniform_and_normal(spark):
    got = spark.range(20000).select(scalar.normal(seeded.keyed(F.col("id"), 3)).alias("g"), scalar.fraction(seeded.keyed(F.col("id"), 3)).alias("u")).toPandas()
    assert abs(got.g.mean()) < 0.03 and abs(got.g.std() - 1) < 0.03 and np.abs(np.sort(got.u) - np.linspace(0, 1, 20000)).max() < 0.02


def test_batches_fit_each_other(spark):
    one = spark.range(37).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    other = spark.range(37).select((F.col("id") + 100).alias("k"), (F.col("id") * 3).alias("v")).repartition(5)
    a, b = ({(r.batch, r.j): r.v for r in seeded.batches(t, "k", 4, 16).collect()} for t in (one, other))
    assert len(a) == 64 and all(b[s] * 2 == v * 3 for s, v in a.items())
    assert [a[s // 16, s % 16] // 2 for s in range(64)] == [min(mix(s ^ 0x2815DB5B) // (M // 37), 36) for s in range(64)]
    ordered = {(r.batch, r.j): r.v for r in seeded.batches(one, "k", 4, 16, shuffle=False).collect()}
    assert [ordered[s // 16, s % 16] // 2 for s in range(64)] == [s % 37 for s in range(64)]
    assert seeded.batches(one.limit(0), "k", 2, 4).count() == 0


def test_weighted_draws_follow_weights(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 4).alias("w"))
    got = [r.w for r in seeded.weighted(rows, "id", F.col("w"), 300).collect()]
    assert len(got) == 300 and 0 not in got and abs(got.count(3) / 300 - 0.5) < 0.1 and abs(got.count(1) / 300 - 1 / 6) < 0.07


def test_permutation(spark):
    got = {r.id: r.place for r in seeded.permuted(spark.range(500), "id", 1).collect()}
    assert sorted(got.values()) == list(range(500)) and got != {r.id: r.place for r in seeded.permuted(spark.range(500), "id", 2).collect()}


def test_first_trial_is_the_order_of_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(s), None if rng.random() < 0.2 else int(g), int(g if rng.random() < 0.5 + g / 15 else rng.integers(0, 9))) for i, (s, g) in enumerate(zip(rng.integers(0, 2, 1500), rng.integers(0, 8, 1500)))]
    table = spark.createDataFrame(rows, "vertex_id long, scene long, gt_id long, pred_id long")
    trials = seeded.tie_orders(table, 20, 30).collect()
    even = {r.scene: r for r in masks.average_precision(table, 20, score="even").collect()}
    for r in trials:
        if r.trial == 0:
            assert all(abs(r[c] - even[r.scene][c]) < 1e-5 for c in ("ap", "ap50", "ap25"))
    assert len(trials) == 60 and len({r.ap for r in trials if r.scene == 1}) > 3
