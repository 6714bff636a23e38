"""Masks as pixels and runs: erosion, dilation, boundary bands and distance transforms.

Boxes are separable: a mask's rows become runs, which shrink or grow at their ends, then its columns. Comparisons and the
distance transform take runs, which are dealt out by mask, so pixels are never shuffled; a task holds one mask's box at a time.
Pixels: frame_idx, obj_id, row, col, one row a pixel, and any more key columns that are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["frame_idx", "obj_id"]
RADII = (1, 2, 3, 5, 8)


def runs(pixels: DataFrame, line: str, at: str, keys: list[str]) -> DataFrame:
    """(keys, line, a, b): the longest runs a <= at < b of each line."""
    own = [*keys, line]
    island = F.col(at) - F.row_number().over(Window.partitionBy(*own).orderBy(at))
    return pixels.select(*own, F.col(at), island.alias("_i")).groupBy(*own, "_i").agg(F.min(at).alias("a"), (F.max(at) + 1).alias("b")).drop("_i")


def spread(rows: DataFrame, line: str, at: str, keys: list[str]) -> DataFrame:
    return rows.where("a < b").select(*keys, line, F.explode(F.expr("sequence(a, b - 1)")).alias(at))


def eroded(pixels: DataFrame, radius: Column, keys: list[str] = KEYS) -> DataFrame:
    """Pixels whose box of 2 * radius + 1 is all mask; what lies outside the image is none. radius: of the keys."""
    for line, at in (("row", "col"), ("col", "row")):
        pixels = spread(runs(pixels, line, at, keys).select(*keys, line, (F.col("a") + radius).alias("a"), (F.col("b") - radius).alias("b")), line, at, keys)
    return pixels


def dilated(pixels: DataFrame, radius: Column, width: Column, height: Column, keys: list[str] = KEYS) -> DataFrame:
    """Pixels of the image whose box of 2 * radius + 1 meets the mask. radius, width, height: of the keys."""
    for line, at, size in (("row", "col", width), ("col", "row", height)):
        wide = runs(pixels, line, at, keys).select(*keys, line, F.greatest(F.col("a") - radius, F.lit(0)).alias("a"), F.least(F.col("b") + radius, size).alias("b"))
        before = Window.partitionBy(*keys, line).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
        wide = wide.withColumn("a", F.greatest("a", F.coalesce(F.max("b").over(before), F.lit(0))))  # what an earlier run covers
        pixels = spread(wide, line, at, keys)
    return pixels


def band_radius(width: Column, height: Column, ratio: float = 0.02) -> Column:
    """A share of the image's diagonal, rounded half to even, one at least."""
    return F.greatest(F.bround(ratio * F.sqrt(width * width + height * height)), F.lit(1.0)).cast("int")


def band(pixels: DataFrame, radius: Column, keys: list[str] = KEYS) -> DataFrame:
    """The mask's pixels within radius of its outside."""
    place = [*keys, "row", "col"]
    return pixels.select(*place).join(eroded(pixels, radius, keys).select(*place), place, "left_anti")


def overlap(truth: DataFrame, found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, iou) of all keys of either side; 0 where both are empty."""
    place = [*keys, "row", "col"]
    both = truth.select(*place, F.lit(1).alias("t"), F.lit(0).alias("f")).union(found.select(*place, F.lit(0), F.lit(1)))
    both = both.groupBy(*place).agg(F.max("t").alias("t"), F.max("f").alias("f"))
    return both.groupBy(*keys).agg((F.sum(F.col("t") * F.col("f")) / F.count(F.lit(1))).alias("iou"))


def lines(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, row, a, b): a mask's runs a <= col < b, which may overlap. rows: these, or pixels."""
    return rows.select(*keys, "row", "a", "b") if "a" in rows.columns else runs(rows, "row", "col", keys)


def listed(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """A row a mask: keys, and the runs' columns row, a, b and those named more as arrays. One shuffle of runs."""
    names = ["row", "a", "b"]
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)  # few bytes, but work for every core
    held = rows.groupBy(*keys, *more).agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in names], *[F.col("side")] * ("side" in rows.columns))).alias("_r"))
    names = [*names, "side"] if "side" in rows.columns else names
    return held.select(*keys, *more, *[F.col(f"_r.{c}").alias(c) for c in names])


def cut(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of each of a batch's rows."""
    held = [batch.column(c) for c in names]
    parts = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in held]
    for i in range(batch.num_rows):
        yield tuple(v[at[i] : at[i + 1]] for at, v in parts)


def painted(row: np.ndarray, a: np.ndarray, b: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The image of runs in a box of rows and columns that holds them."""
    r0, r1, c0, c1 = box
    step = np.zeros((r1 - r0, c1 - c0 + 1), np.int32)
    np.add.at(step, (row - r0, a - c0), 1)
    np.add.at(step, (row - r0, b - c0), -1)
    return step.cumsum(axis=1)[:, :-1] > 0


def counted(mask: np.ndarray, d: int, axis: int) -> np.ndarray:
    """How many of the 2 d + 1 pixels along an axis around each one are mask; those beyond the box aren't."""
    n = mask.shape[axis]
    total = np.concatenate([np.zeros_like(mask.take([0], axis), np.int32), mask.cumsum(axis=axis, dtype=np.int32)], axis=axis)
    i = np.arange(n)
    return total.take(np.minimum(i + d + 1, n), axis) - total.take(np.maximum(i - d, 0), axis)


def core_and_wide(mask: np.ndarray, d: int, which: str) -> np.ndarray:
    """Erosion (`core`) or dilation (`wide`) by a box."""
    least = 2 * d + 1 if which == "core" else 1
    return counted(counted(mask, d, 0) >= least, d, 1) >= least


def iou_of(x: np.ndarray, y: np.ndarray) -> float:
    either = int((x | y).sum())
    return int((x & y).sum()) / either if either else 0.0


def compared(truth: DataFrame, found: DataFrame, width: Column, height: Column, bands: bool = True, radii: tuple[int, ...] = RADII) -> DataFrame:
    """(frame_idx, obj_id, iou, boundary_iou, radius, wide) of all masks of either side: IoU, that of the boundary bands (0 without
    `bands`), and the dilation of the found mask under which it agrees best with the true one, ties to the least radius.

    truth, found: pixels or runs. Runs are dealt out once, by mask; a task holds the box around one mask at a time.
    """
    sided = lines(truth).withColumn("side", F.lit(0)).union(lines(found).withColumn("side", F.lit(1)))
    held = listed(sided, KEYS).withColumn("_w", width.cast("int")).withColumn("_h", height.cast("int")).withColumn("_d", band_radius(width, height))
    most = max(radii, default=0)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sizes = zip(*(batch.column(c).to_pylist() for c in ("_w", "_h", "_d")), strict=True)
            for (row, a, b, side), (w, h, d) in zip(cut(batch, "row", "a", "b", "side"), sizes, strict=True):
                box = max(row.min() - most, 0), min(row.max() + 1 + most, h), max(a.min() - most, 0), min(b.max() + most, w)
                t, f = (painted(row[side == s], a[side == s], b[side == s], box) for s in (0, 1))
                edge = iou_of(t & ~core_and_wide(t, d, "core"), f & ~core_and_wide(f, d, "core")) if bands else 0.0
                best = max(((iou_of(t, core_and_wide(f, r, "wide")), -r) for r in radii), default=(0.0, 0))
                out.append((iou_of(t, f), edge, -best[1], best[0]))
            values = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.float64(), pa.float64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[*KEYS, "iou", "boundary_iou", "radius", "wide"])

    own = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in KEYS)
    return held.mapInArrow(compare, f"{own}, iou double, boundary_iou double, radius int, wide double")


def boundary_overlap(truth: DataFrame, found: DataFrame, width: Column, height: Column) -> DataFrame:
    """(frame_idx, obj_id, iou, boundary_iou) of masks and of their boundary bands (E3). width, height: of frame_idx."""
    return compared(truth, found, width, height, radii=()).select(*KEYS, "iou", "boundary_iou")


def best_dilation(truth: DataFrame, found: DataFrame, width: Column, height: Column, radii: tuple[int, ...] = RADII) -> DataFrame:
    """(frame_idx, obj_id, radius, iou): the dilation under which a found mask agrees best with the true one; ties to the least radius."""
    return compared(truth, found, width, height, False, radii).select(*KEYS, "radius", F.col("wide").alias("iou"))


def distances(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest one outside the mask but in the image; infinite where there is none."""
    far = np.where(mask, np.inf, 0.0)
    for axis in (1, 0):
        best, k = far.copy(), 1
        while k < far.shape[axis] and k * k < best[mask].max(initial=0.0):
            moved = far.swapaxes(0, axis)
            view = best.swapaxes(0, axis)
            np.minimum(view[k:], moved[:-k] + k * k, out=view[k:])
            np.minimum(view[:-k], moved[k:] + k * k, out=view[:-k])
            k += 1
        far = best
    return far


def interior_points(pixels: DataFrame, width: Column, height: Column) -> DataFrame:
    """(frame_idx, obj_id, row, col, d2, x, y): the pixel farthest from the outside of its mask, the first in reading order, and
    its centre as shares of the image. Masks, pixels or runs, are dealt as runs, many a task, which holds one's box at a time."""
    held = listed(lines(pixels), KEYS).withColumn("width", width.cast("int")).withColumn("height", height.cast("int"))

    def deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sizes = zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True)
            for (row, a, b), (w, h) in zip(cut(batch, "row", "a", "b"), sizes, strict=True):
                # the mask's box and one pixel around it hold the nearest pixels outside
                box = max(row.min() - 1, 0), min(row.max() + 2, h), max(a.min() - 1, 0), min(b.max() + 1, w)
                mask = painted(row, a, b, box)
                d = distances(mask)
                r, c = divmod(int(np.argmax(np.where(mask, d, -1.0))), mask.shape[1])
                out.append((int(r + box[0]), int(c + box[2]), float(d[r, c])))
            values = list(zip(*out, strict=True)) or [[]] * 3
            types = [pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "width", "height")), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[*KEYS, "width", "height", "row", "col", "d2"])

    own = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in KEYS)
    found = held.mapInArrow(deepest, f"{own}, width int, height int, row int, col int, d2 double")
    return found.select(*KEYS, "row", "col", "d2", ((F.col("col") + 0.5) / F.col("width")).alias("x"), ((F.col("row") + 0.5) / F.col("height")).alias("y"))
