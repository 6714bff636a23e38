"""Evaluation protocols over id maps and true masks: open vocabulary (E5) and grounded selection.

id_maps: frame_idx, instance, row, a, b, disjoint runs a <= col < b of the pixels that are of an instance. truth: frame_idx,
category, row, a, b, runs that may overlap. Encoders and detectors are outside: their vectors and masks are input tables.
Categories and instances are as many as a scene has; runs are joined by line and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.operators.graph import durable
from cellarium.operators.morphology import compared

PAIR = ["frame_idx", "obj_id"]


def pooled(crops: DataFrame) -> DataFrame:
    """(instance, vec): the mean of an instance's unit crop vectors (instance, vec), as a unit vector."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    parts = crops.select("instance", F.posexplode(F.transform("vec", lambda x: x / norm(F.col("vec")))).alias("i", "x")).groupBy("instance", "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("instance").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec"))
    return mean.select("instance", F.transform("vec", lambda x: x / norm(F.col("vec"))).alias("vec"))


def chosen_by_score(text: DataFrame, instances: DataFrame, share: float = 0.85) -> DataFrame:
    """(category, instance): those whose score, less the category's least, is at least a share of the best one's."""
    s = F.aggregate(F.zip_with("t", "vec", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    rows = text.select("category", F.col("vec").alias("t")).crossJoin(instances)  # a stated set of queries against all instances
    of = Window.partitionBy("category")
    rows = rows.select("category", "instance", F.round(s, 9).alias("s")).withColumn("low", F.min("s").over(of)).withColumn("top", F.max("s").over(of))
    return rows.where(F.col("s") - F.col("low") >= share * (F.col("top") - F.col("low"))).select("category", "instance")


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, row, a, b) that overlap as one."""
    line = Window.partitionBy(*keys, "row").orderBy("a", "b")
    new = (F.col("a") > F.coalesce(F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    rows = runs.select(*keys, "row", "a", "b", new.alias("new")).withColumn("_i", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "row", "_i").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_i")


def claimed(runs: DataFrame) -> DataFrame:
    """An id map of masks (frame_idx, obj_id, row, a, b): a pixel is of the least object that has it. A task holds a line's runs."""
    own = runs.groupBy("frame_idx", "row").agg(F.collect_list(F.struct("a", "b", "obj_id")).alias("s"))
    own = own.withColumn("ends", F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x["a"], x["b"]))))))
    parts = own.select("frame_idx", "row", "s", F.explode(F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("a"), F.slice("ends", 2, F.size("ends") - 1).alias("b"))).alias("p")).select("frame_idx", "row", "s", "p.a", "p.b")
    over = F.filter("s", lambda x: (x["a"] <= F.col("a")) & (x["b"] >= F.col("b")))
    return parts.select("frame_idx", F.array_min(F.transform(over, lambda x: x["obj_id"])).alias("instance"), "row", "a", "b").where("instance is not null")


def common(left: DataFrame, right: DataFrame, line: list[str], by: list[str]) -> DataFrame:
    """(by, n): pixels that disjoint runs of both sides share, on lines that are equal in `line`."""
    r = right.withColumnsRenamed({"a": "a2", "b": "b2"})
    both = left.join(r, line).where("a < b2 and a2 < b")
    return both.groupBy(*by).agg(F.sum(F.least("b", "b2") - F.greatest("a", "a2")).alias("n"))


def chosen_by_area(id_maps: DataFrame, grounded: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(category, instance, ioa): instances of the reference view with more than `threshold` of their own area in the category's
    grounded mask (category, row, a, b). id_maps: of the reference view only."""
    area = id_maps.groupBy("instance").agg(F.sum(F.col("b") - F.col("a")).alias("area"))
    inside = common(id_maps, merged(grounded, ["category"]), ["row"], ["category", "instance"])
    return inside.join(area, "instance").select("category", "instance", (F.col("n") / F.col("area")).alias("ioa")).where(F.col("ioa") > threshold)


def scored(id_maps: DataFrame, truth: DataFrame, chosen: DataFrame, width: Column, height: Column) -> DataFrame:
    """(frame_idx, category, iou, boundary_iou, oracle, unclaimed, radius, iou_dilated) for each view that has the category.

    A prediction is the union of the chosen instances, empty where the view shows none. oracle: the best single instance's
    IoU. unclaimed: the share of the true mask that no instance has. radius: the dilation, of 0, 1, 2, 3, 5 and 8, under which
    the prediction agrees best, by iou_dilated.
    """
    id_maps, chosen = durable(id_maps), durable(chosen.select("category", "instance").distinct())
    true = durable(merged(truth.withColumnRenamed("category", "obj_id"), PAIR))
    area = durable(true.groupBy(*PAIR).agg(F.sum(F.col("b") - F.col("a")).alias("area")))
    found = id_maps.join(chosen, "instance").select("frame_idx", F.col("category").alias("obj_id"), "row", "a", "b").join(area, PAIR, "left_semi")
    seen = compared(true, found, width, height)
    size = id_maps.groupBy("frame_idx", "instance").agg(F.sum(F.col("b") - F.col("a")).alias("n"))
    met = common(true, id_maps, ["frame_idx", "row"], [*PAIR, "instance"]).withColumnRenamed("n", "m").join(size, ["frame_idx", "instance"]).join(area, PAIR)
    best = met.groupBy(*PAIR).agg(F.max(F.col("m") / (F.col("n") + F.col("area") - F.col("m"))).alias("oracle"), (1 - F.sum("m") / F.first("area")).alias("unclaimed"))
    rows = durable(seen).join(durable(best), PAIR, "left").fillna({"oracle": 0.0, "unclaimed": 1.0})
    better = F.col("wide") > F.col("iou")
    return rows.select("frame_idx", F.col("obj_id").alias("category"), "iou", "boundary_iou", "oracle", "unclaimed", F.when(better, F.col("radius")).otherwise(0).alias("radius"), F.greatest("iou", "wide").alias("iou_dilated"))


def summary(rows: DataFrame) -> DataFrame:
    """Means over each category's views, then over categories, and over all pairs of a view and a category."""
    values = ["iou", "boundary_iou", "oracle"]
    each = rows.groupBy("category").agg(*[F.avg(c).alias(c) for c in values], F.count(F.lit(1)).alias("views"))
    flat = rows.agg(F.avg("iou").alias("flat_iou"))
    return each.agg(*[F.avg(c).alias(c) for c in values], F.count(F.lit(1)).alias("categories"), F.sum("views").alias("pairs")).join(flat)
