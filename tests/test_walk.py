"""Rays walked tile by tile against a plain walk of each ray."""

import numpy as np
import pytest

from cellarium.operators import rays


def plain(o, d, start, p, near, most):
    cell, t0, out = start, 0.0, []
    for step in range(most):
        best = min(((float(((p[b] + p[cell]) / 2 - o) @ (p[b] - p[cell]) / ((p[b] - p[cell]) @ d)), b) for b in near[cell] if (p[b] - p[cell]) @ d > 0), default=None)
        if best is None:
            break
        if best[0] > t0:
            out.append((step, cell, round(t0, 9), round(best[0], 9)))
        cell, t0 = best[1], max(t0, best[0])
    return out


@pytest.mark.parametrize("tile, most", [(2048, 1024), (7, 1024), (7, 5)])
def test_walk(spark, tile, most):
    rng = np.random.default_rng(4)
    p = rng.uniform(-1, 1, (150, 3))
    order = np.argsort(((p[:, None] - p[None]) ** 2).sum(2), axis=1)
    near = {i: set() for i in range(150)}
    for i in range(149):  # cell 149 has no neighbour
        for j in order[i, 1:9]:
            if j != 149:
                near[i].add(int(j))
                near[int(j)].add(i)
    o, d = rng.uniform(-1.5, 1.5, (60, 3)), rng.normal(size=(60, 3))
    o[:40], start = o[0], [int(((p[:149] - x) ** 2).sum(1).argmin()) for x in o]
    start[59] = 149
    cells = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    adjacency = spark.createDataFrame([(a, b) for a, bs in near.items() for b in bs], "a long, b long")
    table = spark.createDataFrame([(i, *map(float, a), *map(float, b), s) for i, (a, b, s) in enumerate(zip(o, d, start))], "ray long, ox double, oy double, oz double, dx double, dy double, dz double, start long").repartition(3)
    got = {}
    for r in rays.walk(table, cells, adjacency, most, tile).collect():
        got.setdefault(r.ray, []).append((r.step, r.cell, round(r.t0, 9), round(r.t1, 9)))
    for i in range(60):
        assert sorted(got.get(i, [])) == plain(o[i], d[i], start[i], p, near, most), i
    assert rays.walk(table.limit(0), cells, adjacency).count() == 0
