"""The walk of rays from cell to cell (C1), and directions and bases from scatter matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions.scalar import morton
from cellarium.operators.graph import durable
from cellarium.sources.scenes import numbered


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


TILE, RAYS = 2048, 8192


def tiled(cells: DataFrame, adjacency: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(id, tile) of cells (id, x, y, z) along a Morton curve, and of each tile one row with the faces of its cells.

    A face has the neighbour, its tile, the vector to it and the middle between both; a tile has at most `tile` cells.
    """
    spans = cells.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    low, side = [spans[2 * i] or 0.0 for i in range(3)], max([(spans[2 * i + 1] or 0.0) - (spans[2 * i] or 0.0) for i in range(3)]) or 1.0
    code = morton(*[F.floor((F.col(c) - low[i]) / side * 1023) for i, c in enumerate("xyz")])
    place = numbered(cells.withColumn("code", code), ["code", "id"], "k").withColumn("tile", F.floor(F.col("k") / tile)).drop("code", "k")
    place = durable(place)
    at = place.select(F.col("id").alias("a"), "tile", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    to = place.select(F.col("id").alias("b"), F.col("tile").alias("next_tile"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    faces = adjacency.select("a", "b").join(at.hint("merge"), "a").join(to.hint("merge"), "b")
    columns = [*[(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"v{c}") for c in "xyz"], *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(f"m{c}") for c in "xyz"]]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])  # of equally near exits the first is that to the smaller neighbour
        ends = rows[["a", "b", "next_tile"]].to_numpy(np.int64)
        return pd.DataFrame({"tile": [rows["tile"].iloc[0]], "ends": [ends.tobytes()], "faces": [rows[["vx", "vy", "vz", "mx", "my", "mz"]].to_numpy(float).tobytes()]})

    tiles = faces.select("tile", "a", "b", "next_tile", *columns).groupBy("tile").applyInPandas(pack, "tile long, ends binary, faces binary")
    return place.select("id", "tile"), durable(tiles)


FRONT = ["ray", "cell", "step", "t0", "ox", "oy", "oz", "dx", "dy", "dz"]


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rays under way as blocks of one tile; the salt is the task's number, so a tile's blocks of several tasks stay apart."""
    salt, held = TaskContext.get().partitionId(), {}

    def out(tile: int) -> pd.DataFrame:
        rows = pd.concat(held.pop(tile))
        return pd.DataFrame({"tile": [tile], "salt": [salt], "whole": [rows[FRONT[:3]].to_numpy(np.int64).tobytes()], "real": [rows[FRONT[3:]].to_numpy(float).tobytes()]})

    for batch in batches:
        for tile, rows in batch.groupby("tile"):
            for i in range(0, len(rows), RAYS):
                part = rows.iloc[i : i + RAYS]
                if sum(map(len, held.get(tile, []))) + len(part) > RAYS:
                    yield out(tile)
                held.setdefault(tile, []).append(part)
    for tile in list(held):
        yield out(tile)


def through_tile(most: int):
    """Blocks of rays beside their tile: each ray's steps until it ends or leaves; the last one says where it goes on."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ends = np.frombuffer(row.ends, np.int64).reshape(-1, 3)
                faces = np.frombuffer(row.faces, float).reshape(-1, 6)
                ids, first, count = np.unique(ends[:, 0], return_index=True, return_counts=True)
                wide = first[:, None] + np.minimum(np.arange(count.max(initial=1)), count[:, None] - 1)  # repeats the last face
                whole, real = np.frombuffer(row.whole, np.int64).reshape(-1, 3), np.frombuffer(row.real, float).reshape(-1, 7)
                ray, cell, step = (whole[:, i].copy() for i in range(3))
                t0, o, d = real[:, 0].copy(), real[:, 1:4], real[:, 4:]
                live, out = np.arange(len(ray)), []
                while len(live):
                    at = np.minimum(np.searchsorted(ids, cell[live]), len(ids) - 1)
                    live, at = live[ids[at] == cell[live]], at[ids[at] == cell[live]]  # a cell without faces is the end
                    f = faces[wide[at]]
                    dp = f[..., 0] * d[live, None, 0] + f[..., 1] * d[live, None, 1] + f[..., 2] * d[live, None, 2]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gap = (f[..., 3] - o[live, None, 0]) * f[..., 0] + (f[..., 4] - o[live, None, 1]) * f[..., 1] + (f[..., 5] - o[live, None, 2]) * f[..., 2]
                        t = np.where(dp > 0, gap / dp, np.inf)
                    best = t.argmin(axis=1)
                    t1 = t[np.arange(len(live)), best]
                    ok = np.isfinite(t1)
                    live, t1, face = live[ok], t1[ok], wide[at[ok], best[ok]]
                    ends_here = step[live] + 1 >= most
                    away = (ends[face, 2] != row.tile) & ~ends_here
                    out.append(pd.DataFrame({"ray": ray[live], "step": step[live], "cell": cell[live], "t0": t0[live], "t1": t1, "next": np.where(away, ends[face, 1], -1), "tile": np.where(away, ends[face, 2], -1), **{f"{k}{c}": np.where(away, v[live, i], 0.0) for k, v in (("o", o), ("d", d)) for i, c in enumerate("xyz")}}))
                    cell[live], t0[live] = ends[face, 1], np.maximum(t0[live], t1)
                    step[live] += 1
                    live = live[~away & ~ends_here]
                yield pd.concat(out) if out else pd.DataFrame(columns=["ray", "step", "cell", "t0", "t1", "next", "tile", *FRONT[4:]])

    return go


STEPS = "ray long, step long, cell long, t0 double, t1 double, next long, tile long, " + ", ".join(f"{c} double" for c in FRONT[4:])


def walk(rays: DataFrame, cells: DataFrame, adjacency: DataFrame, max_steps: int = 1024, tile: int = TILE) -> DataFrame:
    """(ray, step, cell, t0, t1): the cells that rays (ray, ox, oy, oz, dx, dy, dz, start) pass, in order, as far as they have an exit.

    From a cell (id, x, y, z) a ray leaves through the bisector with a neighbour (adjacency: a, b) that it meets first, among
    those it goes towards; ties go to the smaller neighbour. Rays go as far as their tile of cells reaches, block by block
    beside that tile's faces; then those that left meet their next tile. So a round is a tile crossed, not a step, and no
    round moves the faces of tiles that no ray is in. Rays of one start cell are dealt to as many blocks as they fill.
    """
    place, tiles = tiled(cells, adjacency, tile)
    start = rays.join(place.select(F.col("id").alias("start"), "tile").hint("merge"), "start")
    front = durable(start.select("ray", F.col("start").alias("cell"), F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("t0"), *FRONT[4:], "tile"))
    out = []
    while not out or front.limit(1).count():
        blocks = front.mapInPandas(gathered, "tile long, salt long, whole binary, real binary")
        blocks = durable(blocks)
        asked = blocks.select("tile", "salt").distinct().join(tiles.hint("merge"), "tile")
        steps = durable(blocks.join(asked.hint("merge"), ["tile", "salt"]).mapInPandas(through_tile(max_steps), STEPS))
        out.append(steps)
        front = steps.where("next >= 0").select("ray", F.col("next").alias("cell"), (F.col("step") + 1).alias("step"), F.greatest("t0", "t1").alias("t0"), *FRONT[4:], "tile")
    return _union(out).where("t1 > t0").select("ray", F.col("step").cast("int").alias("step"), "cell", "t0", "t1")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def scatter(rows: DataFrame, vector: Column, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of a vector column: one aggregation, size * (size + 3) / 2 numbers to the driver."""
    e = [F.element_at(vector, i + 1) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    got = rows.agg(F.count(F.lit(1)), *[F.sum(x) for x in e], *[F.sum(e[i] * e[j]) for i, j in pairs]).first()
    outer = np.zeros((size, size))
    for (i, j), v in zip(pairs, got[1 + size :], strict=True):
        outer[i, j] = outer[j, i] = v or 0.0
    return got[0], np.array([v or 0.0 for v in got[1 : 1 + size]]), outer


def principal(rows: DataFrame, vector: Column, size: int, rank: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, basis of `rank` columns) of the centred vectors, the largest variance first; a column's largest entry is positive."""
    n, total, outer = scatter(rows, vector, size)
    mean = total / max(1, n)
    values, vectors = np.linalg.eigh(outer / max(1, n) - np.outer(mean, mean))
    basis = vectors[:, np.argsort(-values, kind="stable")[:rank]]
    return mean, basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])


def projected_rgb(rows: DataFrame, vector: Column, size: int) -> DataFrame:
    """rows with r, g, b from 0 to 255: the projections on the first three axes between their 2 and 98 percent quantiles."""
    mean, basis = principal(rows, vector, size)
    sides = [dot([F.element_at(vector, i + 1) - float(mean[i]) for i in range(size)], [F.lit(float(x)) for x in basis[:, j]]) for j in range(3)]
    rows = rows.withColumns({f"p{j}": s for j, s in enumerate(sides)})
    ends = rows.agg(*[F.percentile(f"p{j}", F.lit(q)) for j in range(3) for q in (0.02, 0.98)]).first()
    out = {}
    for j, c in enumerate("rgb"):
        lo, hi = ends[2 * j] or 0.0, ends[2 * j + 1] or 0.0
        share = (F.col(f"p{j}") - lo) / max(hi - lo, 1e-12)
        out[c] = F.floor(255 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).cast("int")
    return rows.withColumns(out).drop("p0", "p1", "p2")


def up_direction(cameras: DataFrame) -> list[float]:
    """The direction that is least in the cameras' right axes (and a fiftieth of their forward ones), on the side against their down axes.

    cameras: arrays right, down, forward.
    """
    right, forward = (scatter(cameras, F.col(c), 3)[2] for c in ("right", "forward"))
    values, vectors = np.linalg.eigh(right + 0.02 * forward)
    up = vectors[:, 0]
    down = scatter(cameras, F.col("down"), 3)[1]
    return (up * (np.sign(-down @ up) or 1.0)).tolist()
