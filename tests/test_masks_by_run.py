"""Comparisons of masks on runs against the pixel operators and plain images."""

import numpy as np
from pyspark.sql import functions as F

from cellarium.operators import morphology, protocols
from tests.test_morphology import images, pixels, sizes


def moved(masks):
    return {k: np.roll(m, 1, axis=k[0] % 2) for k, m in masks.items() if k[0] != 3}


def test_comparison_equals_the_pixel_operators(spark):
    masks = images()
    true, found, (w, h) = pixels(spark, masks), pixels(spark, moved(masks)), sizes(masks)
    key = lambda rows: {(r.frame_idx, r.obj_id): r for r in rows.collect()}
    d = morphology.band_radius(w, h)
    iou, edge = key(morphology.overlap(true, found)), key(morphology.overlap(morphology.band(true, d), morphology.band(found, d)))
    got = key(morphology.compared(true, found, w, h))
    assert got.keys() == iou.keys() == edge.keys() == masks.keys()
    wide = {r: key(morphology.overlap(true, morphology.dilated(found, F.lit(r), w, h))) for r in morphology.RADII}
    for k, r in got.items():
        best = max((wide[d][k].iou, -d) for d in morphology.RADII)
        assert (r.iou, r.boundary_iou, r.wide, r.radius) == (iou[k].iou, edge[k].iou, best[0], -best[1])


def test_a_comparison_shuffles_runs_not_pixels(spark):
    """One exchange, by mask; masks of a million pixels in a thousand runs."""
    runs = spark.range(1000).select(F.lit(0).cast("long").alias("frame_idx"), F.lit(1).cast("long").alias("obj_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("a"), F.lit(1000).alias("b"))
    got = morphology.best_dilation(runs, runs.where("row < 900"), F.lit(1000), F.lit(1000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    assert got.collect() == [(0, 1, 8, 908 / 1000)]


def test_overlapping_runs_are_merged_and_claimed_by_the_least(spark):
    rows = [(0, 4, 1, 0, 5), (0, 4, 1, 3, 9), (0, 2, 1, 4, 6), (0, 2, 1, 8, 12), (0, 2, 2, 0, 1), (1, 4, 1, 2, 3)]
    runs = spark.createDataFrame(rows, "frame_idx int, obj_id int, row int, a int, b int")
    least, own = {}, set()
    for f, o, r, a, b in rows:
        for c in range(a, b):
            least[f, r, c] = min(o, least.get((f, r, c), o))
            own.add((f, o, r, c))
    spread = lambda rows, k: sorted((x.frame_idx, x[k], x.row, c) for x in rows.collect() for c in range(x.a, x.b))
    assert spread(protocols.claimed(runs), "instance") == sorted((f, o, r, c) for (f, r, c), o in least.items())
    assert spread(protocols.merged(runs, ["frame_idx", "obj_id"]), "obj_id") == sorted(own)
