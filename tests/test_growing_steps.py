"""Steps whose work or memory must not grow faster than their input, on copies and crowds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellarium.operators import boxes, density, masks, nearest, retrieval, seeded
from cellarium.plans.queries import REGISTRY

POINT = "id long, x double, y double, z double"


def test_nearest_of_many_copies(spark):
    """30,000 points in four places; all pairs of copies would be hundreds of millions."""
    rows = spark.range(30_000).select("id", *[((F.col("id") % 4) * k).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (0, "z"))])
    got = nearest.nearest(rows, rows.withColumnRenamed("id", "q"), 3)
    assert got.count() == 90_000
    assert got.where("d <> 0 or id <> q % 4 + 4 * (rank - 1)").count() == 0


def test_nearest_with_ties_between_places(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, 4, (120, 3)).astype(float)
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], POINT)
    got = {}
    for r in nearest.nearest(rows, rows.withColumnRenamed("id", "q"), 5).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.id
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {q: dict(enumerate(map(int, np.lexsort((np.arange(120), d[q]))[:5]), 1)) for q in range(120)}


def test_within_shuffles_no_pairs(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(0, 1, (700, 3))
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], POINT)
    found = boxes.within(boxes.built(rows), rows.withColumnRenamed("id", "q").withColumn("r", F.lit(0.9)))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert {(r.q, r.id) for r in found.collect()} == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.9))}


@pytest.mark.parametrize("n", [1, 2, 900])
def test_tour_equals_plain_code(n):
    p = np.random.default_rng(n).integers(0, 6, (n, 3)) / 7.0
    at, left, want = 0, set(range(1, n)), [0]
    while left:
        at = min(left, key=lambda j: (round(float(((p[j] - p[at]) ** 2).sum()), 12), j))
        left.remove(at)
        want.append(at)
    assert masks.greedy_order(p) == want


def test_tour_of_twenty_thousand_views_looks_through_few_blocks(monkeypatch):
    p, seen = np.random.default_rng(1).normal(size=(20_000, 3)), []
    unique = np.unique
    monkeypatch.setattr(masks.np, "unique", lambda d, **k: seen.append(1) or unique(d, **k))
    assert sorted(masks.greedy_order(p)) == list(range(20_000)) and len(seen) < 20 * 20_000


def test_packing_holds_one_cell():
    frames, out, most = [pd.DataFrame({"cell": [c] * 10, "id": range(10)}) for c in range(5)], [], []

    def fed():
        for i, f in enumerate(frames):
            most.append(i - len(out))
            yield f

    for b in density.packed(["id"])(fed()):
        out.append(b)
    assert [b["rows"].iloc[0] for b in out] == [10] * 5 and max(most) <= 1


def test_top_is_exact_with_copies(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SLICE", 7)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 4))
    x = np.concatenate([base, base, base])
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, feat array<double>").repartition(3)
    s = np.array([[float(sum(a * b for a, b in zip(u, v))) for v in x] for u in x])
    got = {}
    for r in retrieval.top(rows, rows, 4).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.id
    assert got == {q: dict(enumerate(map(int, np.lexsort((np.arange(120), -np.round(s[q], 9)))[:4]), 1)) for q in range(120)}


@pytest.mark.parametrize("name", ["topk_instances_per_query", "best_caption_match", "shifted_max_select"])
def test_retrieval_makes_no_row_for_a_pair(spark, name):
    """Rows that the query's own joins give, by plan: blocks or mean vectors meet queries, never cells."""
    plan = REGISTRY[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "density" not in plan and plan.count("Join Inner\n") == 0


def test_trials_are_scored_by_scene(spark):
    rows = spark.range(400).select(F.col("id").alias("vertex_id"), (F.col("id") % 2).alias("scene"), (F.col("id") % 5).alias("gt_id"), (F.col("id") % 7).alias("pred_id"))
    plan = seeded.tie_orders(rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert "trial_scores(scene" in plan and "explode" not in plan.lower()
