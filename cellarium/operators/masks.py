"""Sequential mask operators (O5, O10, O13, O15, O16), one group a frame, and instance scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_masks(sizes: DataFrame, ious: DataFrame, top: int = 5, min_iou_score: float = 0.0, min_area: int = 1, threshold: float = 0.1) -> DataFrame:
    """Greedy non-maximum suppression by descending score: a mask is kept if its IoU with all kept ones is at most threshold. sizes: frame_idx, obj_id, n, score; ious: frame_idx, a, b, iou."""
    fine = sizes.where((F.col("score") >= min_iou_score) & (F.col("n") >= min_area))
    pairs = ious.where(F.col("iou") > threshold).groupBy("frame_idx", F.col("a").alias("obj_id")).agg(F.collect_set("b").alias("clash"))
    back = ious.where(F.col("iou") > threshold).groupBy("frame_idx", F.col("b").alias("obj_id")).agg(F.collect_set("a").alias("clash2"))
    rows = fine.join(pairs, ["frame_idx", "obj_id"], "left").join(back, ["frame_idx", "obj_id"], "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in pdf.sort_values(["score", "obj_id"], ascending=[False, True]).itertuples():
            clash = {*([] if r.clash is None else r.clash), *([] if r.clash2 is None else r.clash2)}
            if not clash & set(kept):
                kept.append(r.obj_id)
            if len(kept) == top:
                break
        return pd.DataFrame({"frame_idx": pdf["frame_idx"].iloc[0], "obj_id": kept, "place": range(len(kept))})

    return rows.groupBy("frame_idx").applyInPandas(greedy, "frame_idx long, obj_id long, place int")


def split_up(p: np.ndarray, own: np.ndarray, most: int = 256) -> list[np.ndarray]:
    """Indices in blocks of up to `most`, halved along the longest side."""
    if len(own) <= most:
        return [np.sort(own)]
    side = int(np.ptp(p[own], axis=0).argmax())
    half = own[np.argpartition(p[own, side], len(own) // 2)]
    return split_up(p, half[: len(own) // 2], most) + split_up(p, half[len(own) // 2 :], most)


def greedy_order(p: np.ndarray) -> list[int]:
    """From the first point to the nearest one left, by squared distances rounded to 12 digits, ties to the least index. Only blocks
    whose box may hold it are looked through."""
    blocks = split_up(p, np.arange(len(p)))
    home = np.empty(len(p), int)
    for b, own in enumerate(blocks):
        home[own] = b
    low, high, gone = np.array([p[b].min(0) for b in blocks]), np.array([p[b].max(0) for b in blocks]), np.zeros(len(blocks))
    at, order = 0, [0]
    while True:
        b = home[at]
        blocks[b] = blocks[b][blocks[b] != at]
        if not len(blocks[b]):
            gone[b] = np.inf
        if len(order) == len(p):
            return order
        bound = (np.maximum(np.maximum(low - p[at], p[at] - high), 0.0) ** 2).sum(axis=1) + gone
        best = (np.inf, -1)
        while bound[b := int(bound.argmin())] <= best[0] + 1e-11:
            own = blocks[b]
            d = ((p[own] - p[at]) ** 2).sum(axis=1)
            close = d <= d.min() + 2e-12
            value, first = np.unique(d[close], return_index=True)  # the least index of each distance
            best = min(best, *((round(float(v), 12), int(own[close][i])) for v, i in zip(value, first, strict=True)))
            bound[b] = np.inf
            if not np.isfinite(bound).any():
                break
        at = best[1]
        order.append(at)


def tour(centres: DataFrame) -> DataFrame:
    """Greedy nearest-neighbour order of each scene's views (scene, id, x, y, z), from the first id. Each step depends on the one
    before, so a scene is one task."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        order = greedy_order(pdf[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "id": pdf["id"].iloc[order].to_numpy(), "place": range(len(order))})

    return centres.groupBy("scene").applyInPandas(walk, "scene long, id long, place int")


def best_union(overlap: DataFrame) -> DataFrame:
    """Instances added by overlap while the union's IoU with the target rises. overlap: target, pred, both_n, n, target_n; disjoint instances."""
    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        inter = area = 0
        best, kept = 0.0, []
        for r in pdf.sort_values(["both_n", "pred"], ascending=[False, True]).itertuples():
            iou = (inter + r.both_n) / (area + r.n + r.target_n - inter - r.both_n)
            if iou <= best:
                break
            best, inter, area = iou, inter + r.both_n, area + r.n
            kept.append(int(r.pred))
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "members": [len(kept)], "iou": [round(best, 6)]})

    return overlap.groupBy("target").applyInPandas(greedy, "target long, members int, iou double")


def average_precision(vertices: DataFrame, min_size: int = 100, thresholds: tuple[float, ...] = (0.25, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9), score: str = "size") -> DataFrame:
    """A row for each scene: AP over the nine thresholds from 0.5, AP50 and AP25. vertices: vertex_id, gt_id (null: void), pred_id, scene (without it: one row).

    At each threshold predictions, best first, take the free instance with the highest IoU at or above it; those without
    one are dropped if more than that share of theirs is void, else they are false. Ties go by id. A scene without an
    instance of that size scores zero.
    """
    alone = "scene" not in vertices.columns
    vertices = vertices.withColumn("scene", F.lit(0).cast("long")) if alone else vertices.withColumn("scene", F.col("scene").cast("long"))
    known = vertices.where("gt_id is not null")
    preds = vertices.groupBy("scene", "pred_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("gt_id").isNull().cast("double")).alias("void")).where(F.col("n") >= min_size)
    gts = known.groupBy("scene", "gt_id").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") >= min_size)
    both = known.groupBy("scene", "pred_id", "gt_id").agg(F.count(F.lit(1)).alias("both_n")).join(gts, ["scene", "gt_id"])
    rows = preds.join(both, ["scene", "pred_id"], "left").withColumn("iou", F.col("both_n") / (F.col("n") + F.col("g") - F.col("both_n")))
    rows = rows.withColumn("score", F.col("n") if score == "size" else F.lit(1)).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    schema = "scene long, threshold double, pred_id long, score double, tp int"

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        scene, t, used, out = int(pdf["scene"].iloc[0]), float(pdf["threshold"].iloc[0]), set(), []
        order = pdf[["pred_id", "score", "void"]].drop_duplicates("pred_id").sort_values(["score", "pred_id"], ascending=[False, True])
        by = dict(list(pdf.groupby("pred_id")))
        for pred, s, void in order.itertuples(index=False, name=None):
            free = [(-i, g) for i, g in by[pred][["iou", "gt_id"]].itertuples(index=False, name=None) if i == i and i >= t and g not in used]
            if free:
                used.add(min(free)[1])
                out.append((scene, t, pred, s, 1))
            elif void <= t:
                out.append((scene, t, pred, s, 0))
        return pd.DataFrame(out, columns=["scene", "threshold", "pred_id", "score", "tp"])

    marks = rows.groupBy("scene", "threshold").applyInPandas(match, schema)
    order = Window.partitionBy("scene", "threshold").orderBy(F.desc("score"), "pred_id")
    total = gts.groupBy("scene").agg(F.count(F.lit(1)).alias("total"))  # a row a scene
    curve = marks.join(total, "scene").withColumn("recall", F.sum("tp").over(order) / F.greatest(F.col("total"), F.lit(1))).withColumn("precision", F.sum("tp").over(order) / F.row_number().over(order))
    curve = curve.withColumn("envelope", F.max("precision").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("gain", F.col("recall") - F.lag("recall", 1, 0.0).over(order))
    ap = curve.groupBy("scene", "threshold").agg(F.sum(F.col("gain") * F.col("envelope")).alias("ap"))
    at = lambda t: F.coalesce(F.max(F.when(F.col("threshold") == t, F.col("ap"))), F.lit(0.0))
    mean = F.coalesce(F.sum(F.when(F.col("threshold") >= 0.5, F.col("ap"))), F.lit(0.0)) / sum(t >= 0.5 for t in thresholds)
    ap = vertices.select("scene").distinct().join(ap, "scene", "left").groupBy("scene")
    out = ap.agg(F.round(mean, 6).alias("ap"), F.round(at(0.5), 6).alias("ap50"), F.round(at(0.25), 6).alias("ap25"))
    return out.drop("scene") if alone else out


def fisher_threshold(rows: DataFrame, steps: int = 80) -> DataFrame:
    """The cut on a projection (id, inside, p) with the best IoU among `steps` even ones between its 50 and 99.95 percent quantiles."""
    lo, hi = rows.agg(F.percentile("p", F.lit(0.5)), F.percentile("p", F.lit(0.9995))).first()
    cuts = F.explode(F.array(*[F.lit(float(x)) for x in np.linspace(lo, hi, steps)])).alias("cut")
    got = rows.select("inside", "p", cuts).groupBy("cut").agg((F.count_if(F.col("inside") & (F.col("p") >= F.col("cut"))) / F.greatest(F.count_if(F.col("inside") | (F.col("p") >= F.col("cut"))), F.lit(1))).alias("iou"))
    return got.orderBy(F.desc("iou"), "cut").limit(1)  # the first best cut
