"""Seeded order: batches, samples, initial scenes and trials of tie orders from one keyed generator.

What a row gets depends on its key and the seed alone, so partitions, retries and other columns don't change it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions.scalar import MASK, below, normal, seeded
from cellarium.sources.scenes import numbered


def keyed(key: Column, seed: int = 0) -> Column:
    """A row's number for a seed; keys beyond 32 bits are folded."""
    key = key.cast("long")
    return seeded(seeded(F.lit(seed)).bitwiseXOR(key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(F.lit(MASK))))


def batches(rows: DataFrame, order: str, count: int, size: int, shuffle: bool = True) -> DataFrame:
    """(batch, j, and rows' columns): `count` batches of `size` rows, drawn with replacement, or in order and from the start again.

    A draw depends on batch and place alone: other tables of as many rows, in the same order, give batches that fit.
    """
    own = numbered(rows, [order], "_i")
    n = own.count()
    slots = rows.sparkSession.range(count * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("j"), F.col("id").alias("_slot"))
    pick = below(seeded(F.col("_slot")), F.lit(n)) if shuffle else F.col("_slot") % n
    return slots.withColumn("_i", pick if n else F.lit(-1)).join(own, "_i").drop("_i", "_slot")


def permuted(rows: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    """rows with their place, from 0, in a seeded permutation; equal numbers in order of the key."""
    return numbered(rows.withColumn("_draw", keyed(F.col(key), seed)), ["_draw", key], name).drop("_draw")


def weighted(rows: DataFrame, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement, in proportion to weights: those with the least exponential keys. Weights of 0 or less are never drawn."""
    u = (keyed(F.col(key), seed) + 0.5) / float(MASK + 1)
    return rows.where(weight > 0).withColumn("_draw", -F.log(u) / weight).orderBy("_draw", key).limit(n).drop("_draw")


def initial_points(points: DataFrame, order: str, share: float = 0.9, background: int = 5000, seed: int = 0) -> DataFrame:
    """(i, source, x, y, z, density): a share of the points (x, y, z) with replacement and a little moved, source their key, and far
    background points with raw density -0.5."""
    own = numbered(points.select(order, *"xyz"), [order], "_i")
    n = own.count()
    drawn = points.sparkSession.range(int(share * n)).select(F.col("id").alias("i"), below(keyed(F.col("id"), seed), F.lit(n)).alias("_i") if n else F.lit(-1).alias("_i"))
    noise = lambda axis, sd: sd * normal(keyed(3 * F.col("i") + axis, seed + 1))
    near = drawn.join(own, "_i").select("i", F.col(order).alias("source"), *[(F.col(c) + noise(k, 1e-2)).alias(c) for k, c in enumerate("xyz")], F.lit(0.0).alias("density"))
    far = points.sparkSession.range(background).select((F.col("id") + int(share * n)).alias("i"), F.lit(None).cast("long").alias("source"))
    return near.union(far.select("i", "source", *[noise(k, 10.0).alias(c) for k, c in enumerate("xyz")], F.lit(-0.5).alias("density")))


def tie_orders(vertices: DataFrame, min_size: int = 100, trials: int = 100, seed: int = 0) -> DataFrame:
    """(scene, trial, ap, ap50, ap25) of predictions without scores under seeded orders; trial 0 is the order of ids.

    Matching as in `average_precision`. vertices: vertex_id, scene, gt_id (null: void), pred_id. A task holds the overlaps of
    one scene's predictions, once for all trials.
    """
    known = vertices.where("gt_id is not null")
    preds = vertices.groupBy("scene", "pred_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("gt_id").isNull().cast("double")).alias("void")).where(F.col("n") >= min_size)
    gts = known.groupBy("scene", "gt_id").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") >= min_size)
    both = known.groupBy("scene", "pred_id", "gt_id").agg(F.count(F.lit(1)).alias("m")).join(gts, ["scene", "gt_id"])
    total = gts.groupBy("scene").agg(F.count(F.lit(1)).alias("total"))
    rows = preds.join(both, ["scene", "pred_id"], "left").withColumn("iou", F.col("m") / (F.col("n") + F.col("g") - F.col("m"))).join(total, "scene", "left").fillna(0, ["total"])
    trial = F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.when(t == 0, F.col("pred_id").cast("long")).otherwise(seeded(seeded(t + seed).bitwiseXOR(F.col("pred_id").cast("long").bitwiseAND(F.lit(MASK))))))
    lists = rows.groupBy("scene", "pred_id", "void", "total").agg(F.array_sort(F.collect_list(F.when(F.col("iou").isNotNull(), F.struct((-F.col("iou")).alias("i"), "gt_id")))).alias("near"))
    lists = lists.select(F.col("scene").cast("long").alias("scene"), F.col("pred_id").cast("long").alias("pred_id"), "void", F.col("total").cast("long").alias("total"), F.transform("near", lambda x: -x["i"]).alias("iou"), F.transform("near", lambda x: x["gt_id"]).cast("array<long>").alias("gt"), trial.alias("draw"))
    return lists.groupBy("scene").applyInPandas(trial_scores, "scene long, trial int, ap double, ap50 double, ap25 double")


CUTS = (0.25, *np.arange(50, 95, 5) / 100)


def trial_scores(pdf: pd.DataFrame) -> pd.DataFrame:
    """All trials of one scene. A row a prediction: void, total, its instances gt by falling iou, and its draw in each trial."""
    pdf = pdf.sort_values("pred_id")
    draw, void, total = np.stack(pdf["draw"].to_numpy()).T, pdf["void"].to_numpy(), max(int(pdf["total"].iloc[0]), 1)
    trials, preds = draw.shape
    order, row = np.argsort(draw, axis=1, kind="stable"), np.arange(trials)  # equal draws by id
    gts = np.unique(np.concatenate([np.asarray(g, np.int64) for g in pdf["gt"]]))
    most = max(map(len, pdf["gt"]), default=0)
    iou, gt = np.full((preds, most + 1), -1.0), np.zeros((preds, most + 1), int)
    for k, (i, g) in enumerate(zip(pdf["iou"], pdf["gt"], strict=True)):
        iou[k, : len(i)], gt[k, : len(g)] = i, np.searchsorted(gts, np.asarray(g, np.int64))
    ap = {}
    for t in CUTS:
        used = np.zeros((trials, max(len(gts), 1)), bool)
        hit, counts = np.zeros((trials, preds), bool), np.zeros((trials, preds), bool)
        for place in range(preds):
            p = order[:, place]
            free = (iou[p] >= t) & ~used[row[:, None], gt[p]]
            got = free.any(axis=1)
            used[row[got], gt[p[got], free[got].argmax(axis=1)]] = True
            hit[:, place], counts[:, place] = got, got | (void[p] <= t)
        hits, n = np.cumsum(hit, axis=1), np.cumsum(counts, axis=1)
        precision = np.where(counts, hits / np.maximum(n, 1), 0.0)
        precision = np.maximum.accumulate(precision[:, ::-1], axis=1)[:, ::-1]
        ap[t] = (hit / total * precision).sum(axis=1)
    mean = np.mean([v for t, v in ap.items() if t >= 0.5], axis=0)
    return pd.DataFrame({"scene": pdf["scene"].iloc[0], "trial": np.arange(trials, dtype=np.int32), "ap": mean, "ap50": ap[0.5], "ap25": ap[0.25]})
