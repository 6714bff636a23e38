"""Readers of photogrammetry captures: cameras, posed views and sparse points from their binary files.

Files come through Spark's binary file source, so any store that Spark reads will do, and each scene's files are decoded in
the task that read them; a file that can't be decoded becomes a dead letter, and the others go on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The number of parameters of each camera model, by its number in the file format.
PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
# Where a release keeps its reconstruction, images and split file, below the scene's folder.
LAYOUTS = {"pyramid": ("sparse/0", "images", None), "dslr": ("dslr/colmap", "dslr/resized_images", "dslr/train_test_lists.json")}
DOWNSAMPLES = (1, 2, 4, 8)


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise ValueError(f"the file ends at {len(self.data)} within a record at {self.at}")
        self.at += size
        return struct.unpack_from("<" + form, self.data, self.at - size)

    def name(self) -> str:
        stop = self.data.find(b"\0", self.at)
        if stop < 0:
            raise ValueError("the file ends within a name")
        self.at, start = stop + 1, self.at
        return self.data[start:stop].decode()


def cameras_of(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for _ in range(*c.take("Q")):
        camera, model, width, height = c.take("iiQQ")
        if model not in PARAMETERS:
            raise ValueError(f"unknown camera model {model}")
        yield camera, model, width, height, list(c.take(f"{PARAMETERS[model]}d"))


def views_of(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for _ in range(*c.take("Q")):
        image, *pose, camera = c.take("i7di")
        name, (seen,) = c.name(), c.take("Q")
        c.take(f"{24 * seen}x")
        yield image, name, camera, pose[:4], pose[4:], seen


def points_of(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for _ in range(*c.take("Q")):
        point, x, y, z, r, g, b, error, track = c.take("Q3d3BdQ")
        c.take(f"{8 * track}x")
        yield point, x, y, z, r, g, b, error, track


KINDS = {
    "cameras": (cameras_of, "camera_id int, model int, width long, height long, params array<double>"),
    "images": (views_of, "image_id int, name string, camera_id int, q array<double>, t array<double>, observations long"),
    "points3D": (points_of, "point_id long, x double, y double, z double, red int, green int, blue int, error double, track long"),
}


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all scenes' reconstructions below root, in either layout."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(root).select("path", "content")


def scene_of(path: Column) -> Column:
    """The name of the folder above the layout's own ones; null elsewhere."""
    found = F.regexp_extract(path, r"([^/]+)/(?:" + "|".join(d for d, _, _ in LAYOUTS.values()) + r")/[^/]+$", 1)
    return F.when(found != "", found)


def decoded(contents: DataFrame, kind: str, block: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Rows of one kind of file with their scene, and dead letters (path, scene, error). contents: path, content.

    A file with an error gives the letter alone. Rows leave a task in blocks.
    """
    decode, schema = KINDS[kind]
    columns = [c.split()[0] for c in schema.split(", ")]
    own = contents.where(F.regexp_extract("path", r"([^/]+)\.bin$", 1) == kind).withColumn("scene", scene_of(F.col("path")))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, scene in batch[["path", "content", "scene"]].itertuples(index=False, name=None):
                failure, found = None, []
                try:
                    found = list(decode(bytes(content)))
                except (ValueError, struct.error, UnicodeDecodeError) as e:
                    failure = f"{type(e).__name__}: {e}"
                if failure is not None:
                    yield pd.DataFrame({"path": [path], "scene": [scene], "failure": [failure]} | dict.fromkeys(columns, None))
                for i in range(0, len(found), block):
                    part = pd.DataFrame(found[i : i + block], columns=columns)
                    yield part.assign(path=path, scene=scene, failure=None)[["path", "scene", "failure", *columns]]

    both = own.select("path", "content", "scene").mapInPandas(rows, "path string, scene string, failure string, " + schema)
    return both.where("failure is null").drop("failure", "path"), both.where("failure is not null").select("path", "scene", F.col("failure").alias("error"))


def rotation(q: Column) -> list[list[Column]]:
    """World-to-camera rotation of a quaternion w, x, y, z of any length."""
    n = F.sqrt(sum(q[i] * q[i] for i in range(4)))
    w, x, y, z = (q[i] / n for i in range(4))
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def posed(views: DataFrame) -> DataFrame:
    """Views with the camera's place (x, y, z) and the directions it looks in and has to its right and below, in the world."""
    r = rotation(F.col("q"))
    place = {c: -sum(r[k][i] * F.col("t")[k] for k in range(3)) for i, c in enumerate("xyz")}
    return views.withColumns(place | {name: F.array(*r[k]) for k, name in enumerate(("right", "down", "forward"))})


def view_rays(views: DataFrame, cameras: DataFrame, stride: int = 1) -> DataFrame:
    """(scene, image_id, i, j, dx, dy, dz): the unit direction through the centre of each `stride`-th pixel of posed views of pinhole
    cameras (models 0 and 1). A view's pixels are made where the view is, from its camera, of which a scene has one."""
    single = cameras.where("model = 0").select("scene", "camera_id", "width", "height", F.col("params")[0].alias("fx"), F.col("params")[0].alias("fy"), F.col("params")[1].alias("cx"), F.col("params")[2].alias("cy"))
    double = cameras.where("model = 1").select("scene", "camera_id", "width", "height", *[F.col("params")[k].alias(c) for k, c in enumerate(("fx", "fy", "cx", "cy"))])
    rows = views.join(single.union(double), ["scene", "camera_id"])
    rows = rows.withColumn("j", F.explode(F.expr(f"sequence(0, height - 1, {stride})"))).withColumn("i", F.explode(F.expr(f"sequence(0, width - 1, {stride})")))
    u, v = (F.col("i") + 0.5 - F.col("cx")) / F.col("fx"), (F.col("j") + 0.5 - F.col("cy")) / F.col("fy")
    n = F.sqrt(u * u + v * v + 1)
    return rows.select("scene", "image_id", "i", "j", *[((F.col("right")[k] * u + F.col("down")[k] * v + F.col("forward")[k]) / n).alias(f"d{c}") for k, c in enumerate("xyz")])


def single_cameras(cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cameras of scenes that have one, and dead letters (scene, error) of the others."""
    n = cameras.groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    many = n.where("n <> 1").select("scene", F.concat(F.col("n").cast("string"), F.lit(" cameras in one capture")).alias("error"))
    return cameras.join(n.where("n = 1").select("scene"), "scene"), many


def image_folder(root: str, scene: str, layout: str, downsample: int = 1) -> str:
    """Where a scene's images are: a pyramid has a folder for each size, the other layout one that is resized on loading."""
    if downsample not in DOWNSAMPLES:
        raise ValueError(f"downsample must be one of {DOWNSAMPLES}")
    folder = LAYOUTS[layout][1]
    return f"{root.rstrip('/')}/{scene}/{folder}" + (f"_{downsample}" if layout == "pyramid" and downsample > 1 else "")


def layouts(spark: SparkSession, root: str) -> DataFrame:
    """(scene, layout) of all scenes below root, by the folders that their reconstructions are in."""
    paths = files(spark, root).select("path")
    kind = F.coalesce(*[F.when(F.col("path").contains(f"/{d}/"), F.lit(name)) for name, (d, _, _) in LAYOUTS.items()])
    return paths.select(scene_of(F.col("path")).alias("scene"), kind.alias("layout")).where("scene is not null").distinct()


def resolved(name: str, settings: dict[str, str], default: str) -> list[str]:
    """Roots to look for a data set in, best first: its own setting, then the default's folder, then further ones, colon by colon."""
    own, more = settings.get(name.upper()), settings.get(f"{name.upper()}_EXTRA", "")
    return [*([own] if own else []), f"{default.rstrip('/')}/{name}", *(r for r in more.split(":") if r)]


def packed_views(views: DataFrame) -> DataFrame:
    """(path, content): the views file of each scene. views: scene, image_id, name, camera_id, q, t; a file is one scene's views."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = [struct.pack("<Q", len(rows))]
        for r in rows.sort_values("image_id").itertuples():
            out.append(struct.pack("<i7di", r.image_id, *r.q, *r.t, r.camera_id) + r.name.encode() + b"\0" + struct.pack("<Q", 0))
        return pd.DataFrame({"path": [f"{rows['scene'].iloc[0]}/sparse/0/images.bin"], "content": [b"".join(out)]})

    return views.groupBy("scene").applyInPandas(pack, "path string, content binary")
