"""Erosion, dilation and distances on run rows against plain images of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.operators import morphology


def images():
    rng = np.random.default_rng(3)
    out = {}
    for k, (h, w, share) in enumerate([(12, 17, 0.9), (30, 9, 0.97), (5, 5, 1.0), (1, 20, 0.7), (25, 25, 0.5)]):
        out[k, 7] = rng.random((h, w)) < share
    out[5, 1] = np.zeros((40, 40), bool)
    out[5, 1][3:20, 5:33] = True
    return out


def pixels(spark, masks):
    rows = [(f, o, int(r), int(c)) for (f, o), m in masks.items() for r, c in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "frame_idx long, obj_id long, row int, col int")


def sizes(masks):
    pick = lambda i: F.element_at(F.array(*[F.lit(int(m.shape[i])) for m in masks.values()]), (F.col("frame_idx") + 1).cast("int"))
    return pick(1), pick(0)


def box(m, d, f, outside):
    p = np.pad(m, d, constant_values=outside)
    return f([p[d + a : d + a + m.shape[0], d + b : d + b + m.shape[1]] for a in range(-d, d + 1) for b in range(-d, d + 1)], axis=0)


@pytest.mark.parametrize("d", [1, 2, 5])
def test_erosion_and_dilation(spark, d):
    masks = images()
    rows, (w, h) = pixels(spark, masks), sizes(masks)
    for got, f, outside in ((morphology.eroded(rows, F.lit(d)), np.all, False), (morphology.dilated(rows, F.lit(d), w, h), np.any, False)):
        want = {(k, o, int(r), int(c)) for (k, o), m in masks.items() for r, c in zip(*np.nonzero(box(m, d, f, outside)))}
        found = [(r.frame_idx, r.obj_id, r.row, r.col) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_distances_and_interior_points(spark):
    masks = images()
    w, h = sizes(masks)
    got = {(r.frame_idx, r.obj_id): r for r in morphology.interior_points(pixels(spark, masks), w, h).collect()}
    assert got.keys() == masks.keys()
    for k, m in masks.items():
        out = np.argwhere(~m)
        d = np.array([[((out - (r, c)) ** 2).sum(1).min() if len(out) else np.inf for c in range(m.shape[1])] for r in range(m.shape[0])])
        assert (morphology.distances(m) == d).all()
        at = divmod(int(np.argmax(np.where(m, d, -1))), m.shape[1])
        assert (got[k].row, got[k].col, got[k].d2) == (*at, d[at])
        assert abs(got[k].x - (at[1] + 0.5) / m.shape[1]) < 1e-12 and abs(got[k].y - (at[0] + 0.5) / m.shape[0]) < 1e-12


def test_band_radius(spark):
    got = spark.createDataFrame([(10, 10), (60, 45), (96, 72), (1297, 840), (75, 100)], "w int, h int").select(morphology.band_radius(F.col("w"), F.col("h")).alias("d"))
    assert [r.d for r in got.collect()] == [max(1, round(0.02 * float(np.hypot(*s)))) for s in ((10, 10), (60, 45), (96, 72), (1297, 840), (75, 100))]
