"""Readers and writers of runs: frame lists, splits, mask folders, feature blocks, metadata, cluster caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.operators.graph import durable

#: What the tags of mask runs stand for.
PRESETS = {"t70": {"points_per_side": 32, "pred_iou_thresh": 0.70, "stability_thresh": 0.88}, "t60": {"points_per_side": 32, "pred_iou_thresh": 0.60, "stability_thresh": 0.80}}


def numbered(rows: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """rows with their place (from 0) in an order, by ranges: each task numbers its own rows, from the counts before it.

    Only the counts, one a range, come to the driver. Rows that are equal in all columns of the order have any order.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = durable(ranged)  # written out, so that a lost executor can't deal the ranges anew
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):
        offsets.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    return ranged.join(F.broadcast(table), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def choose_split(frames: DataFrame, split: str, released: DataFrame | None = None, trained: DataFrame | None = None, every: int = 8, most: int = 300) -> DataFrame:
    """Frames (column name) of a split, `train` or `test`, by the first rule that applies.

    released: columns name and split, matched by the names' last part; of more than `most` training frames as many stay,
    evenly spread, and a list that names no frame of the split is an error. Else trained: the column name of the training
    folder's files; all other frames are for tests. Else each `every`-th frame in the order of names is for tests. frames
    has one row a name.
    """
    if released is not None and released.limit(1).count():
        own = released.where(F.col("split") == split).select(basename(F.col("name")).alias("_base")).distinct()
        chosen = frames.withColumn("_base", basename(F.col("name"))).join(own, "_base", "left_semi").drop("_base")
        if not chosen.limit(1).count():
            raise ValueError(f"the released lists name no {split} frame that is there")
        return strided(chosen, ["name"], most) if split == "train" else chosen
    if trained is not None and trained.limit(1).count():
        own = trained.select(basename(F.col("name")).alias("_base")).distinct()
        return frames.withColumn("_base", basename(F.col("name"))).join(own, "_base", "left_semi" if split == "train" else "left_anti").drop("_base")
    held = F.col("_i") % every == 0
    return numbered(frames, ["name"], "_i").where(held if split == "test" else ~held).drop("_i")


def strided(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """All rows if they are at most `most`, else those at floor(i n / most) for i from 0."""
    rows = numbered(rows, order, "_i")
    n = rows.count()
    if n > most:
        # place p is taken iff the first i with floor(i n / most) >= p gives p
        i = F.ceil(F.col("_i") * most / F.lit(float(n)))
        rows = rows.where(F.floor(i * n / F.lit(float(most))) == F.col("_i"))
    return rows.drop("_i")


def frame_index(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, name) from an index file: an object with an array `names`, in order."""
    doc = spark.read.option("multiLine", True).schema("names array<string>").json(path)
    return doc.select(F.posexplode("names").alias("frame_idx", "name"))


def number_frames(frames: DataFrame) -> DataFrame:
    """(frame_idx, name): different names in order, which a tracker reads as a gapless sequence."""
    return numbered(frames.select("name").distinct(), ["name"], "frame_idx").select("frame_idx", "name")


def write_frame_index(frames: DataFrame, path: str) -> None:
    """The index of one scene, which has as many names as the scene has frames, as `frame_index` reads it."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "name"))), lambda f: f["name"])
    frames.agg(names.alias("names")).coalesce(1).write.mode("overwrite").json(path)


def resolve_folder(spark: SparkSession, roots: list[str], below: str, index: str) -> str | None:
    """The first root whose folder `below` has the index file; None if no root has."""
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{below}/{index}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return f"{root.rstrip('/')}/{below}"
    return None


def grey_masks(spark: SparkSession, pattern: str, above: int = 127) -> DataFrame:
    """(view, prompt, height, width, pixels) of mask files `view/prompt.pgm`, binary grey maps; pixels are places row * width + col above a grey.

    A file that is no such map gives a row with null sizes and the reason in `failure`; the others are read.
    """
    def decode(content: bytes) -> tuple[int, int, list[int]]:
        import numpy as np

        fields, at = [], 0
        while len(fields) < 4:  # magic, width, height, maximum; comments run to the line's end
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while end < len(content) and not content[end : end + 1].isspace():
                end += 1
            if end == at:
                raise ValueError("the header ends early")
            fields.append(content[at:end])
            at = end
        if fields[0] != b"P5":
            raise ValueError("not a binary grey map")
        width, height, most = map(int, fields[1:])
        if most > 255:
            raise ValueError("more than one byte a pixel")
        grey = np.frombuffer(content, np.uint8, width * height, at + 1)
        return height, width, np.flatnonzero(grey > above).tolist()

    files = spark.read.format("binaryFile").load(pattern)
    files = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("view"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("prompt"), "content")
    return captured(files, ["view", "prompt"], lambda row: dict(zip(("height", "width", "pixels"), decode(bytes(row["content"])), strict=True)), "height int, width int, pixels array<long>")


def captured(rows: DataFrame, keys: list[str], work: Callable[[dict], dict], schema: str) -> DataFrame:
    """keys, what `work` makes of each row (columns of `schema`) and failure: null, or the error of a row, whose results are null.

    One bad record costs its own result only; rows with a failure are the dead letters.
    """
    made = [c.split()[0] for c in schema.split(", ")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                own = [row[k] for k in keys]
                try:
                    found = work(row)
                    out.append([*own, *[found[c] for c in made], None])
                except Exception as error:  # noqa: BLE001
                    out.append([*own, *[None] * len(made), f"{type(error).__name__}: {error}"])
            yield pd.DataFrame(out, columns=[*keys, *made, "failure"], dtype=object)

    return rows.mapInPandas(each, f"{types}, {schema}, failure string")


def polygon_masks(polygons: DataFrame, grid: tuple[int, int], source: tuple[int, int]) -> DataFrame:
    """(view, category, row, col): pixel centres inside any polygon of a category, even-odd rule.

    polygons: view, category, polygon_id, points (an array of [x, y] in the source's pixels). grid and source: (height,
    width). Polygons of fewer than three points are skipped. A polygon meets the pixels of its own bounds only.
    """
    (h, w), (sh, sw) = grid, source
    p = polygons.where(F.size("points") >= 3)
    x, y = F.transform("points", lambda q: q[0] * (w / sw)), F.transform("points", lambda q: q[1] * (h / sh))
    p = p.select("view", "category", "polygon_id", x.alias("x"), y.alias("y"))
    between = lambda c, most: F.sequence(F.greatest(F.floor(F.array_min(c)), F.lit(0)).cast("int"), F.least(F.ceil(F.array_max(c)), F.lit(most - 1)).cast("int"))
    seen = (F.array_max("x") >= 0) & (F.array_min("x") < w) & (F.array_max("y") >= 0) & (F.array_min("y") < h)
    p = p.where(seen).withColumn("row", F.explode(between("y", h)))
    # a row's crossings with the outline are found once; a centre is inside if an odd number lie left of it
    v = F.col("row") + 0.5
    n = F.size("x")

    def crossing(i: Column) -> Column:
        j = F.when(i + 1 < n, i + 2).otherwise(F.lit(1))
        ax, ay, bx, by = F.element_at("x", i + 1), F.element_at("y", i + 1), F.element_at("x", j), F.element_at("y", j)
        return F.when((ay > v) != (by > v), ax + (v - ay) * (bx - ax) / F.when(by != ay, by - ay))

    p = p.withColumn("cuts", F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), crossing)))
    p = p.withColumn("col", F.explode(between("x", w)))
    inside = F.size(F.filter("cuts", lambda c: c < F.col("col") + 0.5)) % 2 == 1
    return p.where(inside).select("view", "category", "row", "col").distinct()


def feature_block(cells: DataFrame, name: str) -> DataFrame:
    """(cell_id, feat) alone: a scan reads these two columns."""
    return cells.select("cell_id", F.col(name).alias("feat"))


def gathered(rows: DataFrame, wanted: DataFrame, key: str = "cell_id") -> DataFrame:
    """All columns of the rows whose key is wanted, once a row, however often the key is."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def appended(rows: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows and, below them, new ones; columns that the new ones lack have a default, or null."""
    lacking = {f.name: defaults.get(f.name, F.lit(None)).cast(f.dataType) for f in rows.schema if f.name not in new.columns}
    return rows.unionByName(new.withColumns(lacking).select(*rows.columns) if lacking else new.select(*rows.columns))


def with_preset(config: dict, tag: str | None) -> dict:
    """A configuration with a tag's settings in place of its own; other tags stand for none."""
    return config | PRESETS.get(tag, {})


def write_metadata(entries: DataFrame, path: str) -> None:
    """Adds entries (run, key, value) to a run's metadata; `epoch` tells the additions apart."""
    spark = entries.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    last = read_epochs(spark, path).agg(F.max("epoch")).first()[0] if known else None
    entries.select("run", "key", "value", F.lit(0 if last is None else last + 1).cast("long").alias("epoch")).write.mode("append").parquet(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, key string, value string, epoch long").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(run, key, value): of each key the value of the last addition, so what an earlier part of a run wrote is carried on."""
    return read_epochs(spark, path).groupBy("run", "key").agg(F.max_by("value", "epoch").alias("value"))


def write_labels(labels: DataFrame, path: str, fingerprint: str, seed: int, method: str, params: dict[str, str]) -> None:
    """The cache of a clustering: labels (cell_id, label), and a row that says what they were made from."""
    spark = labels.sparkSession
    labels.select("cell_id", "label").write.mode("overwrite").parquet(f"{path}/labels")
    known = spark.createDataFrame([(fingerprint, seed, method, {k: str(v) for k, v in params.items()})], "fingerprint string, seed long, method string, params map<string,string>")
    known.coalesce(1).write.mode("overwrite").parquet(f"{path}/made")


def read_labels(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """The cached labels; an error if they were made from other features."""
    made = spark.read.parquet(f"{path}/made").first()
    if made["fingerprint"] != fingerprint:
        raise ValueError(f"the labels in {path} were made from other features")
    return spark.read.parquet(f"{path}/labels")


def write_embeddings(rows: DataFrame, path: str) -> None:
    """(instance_id, vec), by instance; an instance without a vector or with two is an error."""
    bad = rows.groupBy("instance_id").agg(F.count("vec").alias("n")).where("n <> 1")
    if bad.limit(1).count():
        raise ValueError("an instance has no vector or more than one")
    rows.select("instance_id", "vec").write.mode("overwrite").parquet(path)


def best_views(views: DataFrame, most: int = 5, least_area: int = 64) -> DataFrame:
    """(instance_id, view, score, rank): an instance's best views by the visible share times the area's share of its largest."""
    of = Window.partitionBy("instance_id")
    score = F.col("visible") / F.col("total") * F.col("area") / F.max("area").over(of)
    rows = views.where((F.col("area") >= least_area) & (F.col("total") > 0)).withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "view"))).where(F.col("rank") <= most).select("instance_id", "view", "score", "rank")
