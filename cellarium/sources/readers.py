"""Readers and writers of the domain's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines, as scene and class lists hold them."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def camera_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a transforms file: name, c2w (16 numbers, row by row) and the focal length over half the width."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.posexplode("frames").alias("view_id", "f"), "camera_angle_x").select("view_id", F.col("f.file_path").alias("name"), F.flatten("f.transform_matrix").alias("c2w"), (1 / F.tan(F.col("camera_angle_x") / 2)).alias("focal"))


def ground_truth(spark: SparkSession, segments: str, groups: str, classes: list[str] | None = None) -> DataFrame:
    """(vertex_id, instance_id, label) from a segments file and an annotation file, restricted to classes; empty groups vanish."""
    seg = spark.read.option("multiLine", True).json(segments).select(F.posexplode("segIndices").alias("vertex_id", "seg_id"))
    own = spark.read.option("multiLine", True).json(groups).select(F.posexplode("segGroups").alias("instance_id", "g")).select("instance_id", "g.label", F.explode("g.segments").alias("seg_id"))
    if classes is not None:
        own = own.where(F.col("label").isin(classes))
    return seg.join(own, "seg_id").select("vertex_id", "instance_id", "label")


def results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result files, keyed by the folder's and the file's name."""
    rows = spark.read.option("multiLine", True).json(pattern).withColumn("file", F.input_file_name())
    return rows.select("*", F.regexp_extract("file", r"([^/]+)/[^/]+\.json$", 1).alias("scene_dir"), F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("stem"))


def decode_rle(masks: DataFrame) -> DataFrame:
    """(frame_idx, obj_id, pixel) of masks whose rle lists start:length pairs, 1-based."""
    run = F.split(F.col("r"), ":")
    rows = masks.select("frame_idx", "obj_id", F.explode(F.split("rle", ",")).alias("r")).where("r <> ''")
    return rows.select("frame_idx", "obj_id", F.explode(F.sequence(run[0].cast("long") - 1, run[0].cast("long") + run[1].cast("long") - 2)).alias("pixel"))


def resize_nearest(labels: DataFrame, size: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Label pixels (frame_idx, row, col, obj_id) at another (height, width), by the nearest source pixel."""
    grid = labels.sparkSession.range(new[0] * new[1]).select(F.floor(F.col("id") / new[1]).alias("row"), (F.col("id") % new[1]).alias("col"))
    grid = grid.select(F.col("row").alias("r"), F.col("col").alias("c"), F.floor(F.col("row") * size[0] / new[0]).alias("row"), F.floor(F.col("col") * size[1] / new[1]).alias("col"))
    return labels.join(grid, ["row", "col"]).select("frame_idx", F.col("r").alias("row"), F.col("c").alias("col"), "obj_id")


def unmatched(images: DataFrame, frames: DataFrame) -> DataFrame:
    """Images without a frame of the same name; a loader must find none."""
    return images.join(frames, "name", "left_anti")


def write_scene(cells: DataFrame, edges: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_scene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/edges")


def write_masks(masks: DataFrame, path: str) -> None:
    """Masks (frame_idx, level, obj_id, rle), partitioned; ids outside 0..65535 are an error."""
    if masks.where(~F.col("obj_id").between(0, 65535)).limit(1).count():
        raise ValueError("an object id is outside 0..65535")
    masks.write.mode("overwrite").partitionBy("frame_idx", "level").parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("scene", "config").json(path)


def write_official(rows: DataFrame, path: str) -> None:
    """Index lines `path class score`."""
    line: Column = F.concat_ws(" ", "path", F.col("class").cast("string"), F.format_number("score", 4))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
