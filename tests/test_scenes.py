"""Readers and writers of runs, against plain code on small files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.sources import scenes


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def frames(spark, n, folder="images"):
    own = [(f"{folder}/{i:04d}.jpg", i) for i in range(n)]
    random.Random(1).shuffle(own)
    return spark.createDataFrame(own, "name string, camera long")


def test_numbered(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    got = sorted((r.k, r.i) for r in scenes.numbered(rows, ["k"]).collect())
    assert [i for _, i in got] == list(range(1000))
    assert scenes.numbered(rows.limit(0), ["k"]).count() == 0


def test_split_by_release(spark):
    released = spark.createDataFrame([("0001.jpg", "train"), ("x/0002.jpg", "test"), ("0003.jpg", "train")], "name string, split string")
    own = frames(spark, 6)
    assert names(scenes.choose_split(own, "train", released)) == ["images/0001.jpg", "images/0003.jpg"]
    assert names(scenes.choose_split(own, "test", released, trained=own)) == ["images/0002.jpg"]


def test_split_by_folder(spark):
    trained = spark.createDataFrame([("images_train/0004.jpg",), ("images_train/0000.jpg",)], "name string")
    own = frames(spark, 6)
    assert names(scenes.choose_split(own, "train", trained=trained)) == ["images/0000.jpg", "images/0004.jpg"]
    assert len(names(scenes.choose_split(own, "test", trained=trained))) == 4


@pytest.mark.parametrize("n, most", [(50, 300), (50, 7), (343, 300), (17, 1)])
def test_split_by_holdout(spark, n, most):
    own = [f"images/{i:04d}.jpg" for i in range(n)]
    train = [x for i, x in enumerate(own) if i % 8]
    assert names(scenes.choose_split(frames(spark, n), "train", most=most)) == train
    if len(train) > most:  # only released lists are thinned
        thin = [train[int(i * len(train) / most)] for i in range(most)]
        released = spark.createDataFrame([(x, "train") for x in train], "name string, split string")
        assert names(scenes.choose_split(frames(spark, n), "train", released, most=most)) == thin
        with pytest.raises(ValueError):
            scenes.choose_split(frames(spark, n), "test", released)
    assert names(scenes.choose_split(frames(spark, n), "test", most=most)) == own[::8]


def test_frame_index(spark, tmp_path):
    own = scenes.number_frames(frames(spark, 20).union(frames(spark, 5)))
    scenes.write_frame_index(own, f"file://{tmp_path}/index")
    got = {r.frame_idx: r.name for r in scenes.frame_index(spark, f"file://{tmp_path}/index").collect()}
    assert got == {i: f"images/{i:04d}.jpg" for i in range(20)}


def test_resolve_folder(spark, tmp_path):
    (tmp_path / "b" / "s1").mkdir(parents=True)
    (tmp_path / "b" / "s1" / "index.json").write_text("{}")
    roots = [f"file://{tmp_path}/a", f"file://{tmp_path}/b/"]
    assert scenes.resolve_folder(spark, roots, "s1", "index.json") == f"file://{tmp_path}/b/s1"
    assert scenes.resolve_folder(spark, roots, "s2", "index.json") is None


def test_grey_masks_and_dead_letters(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    grey = np.array([[0, 127, 128], [255, 10, 200]], np.uint8)
    (tmp_path / "v1" / "a cup.pgm").write_bytes(b"P5\n# made by hand\n3 2\n255\n" + grey.tobytes())
    (tmp_path / "v1" / "short.pgm").write_bytes(b"P5 9 9 255\n123")
    (tmp_path / "v1" / "text.pgm").write_bytes(b"nothing")
    got = {r.prompt.replace("%20", " "): r for r in scenes.grey_masks(spark, f"file://{tmp_path}/*/*.pgm").collect()}
    cup = got["a cup"]
    assert (cup.view, cup.height, cup.width, cup.pixels, cup.failure) == ("v1", 2, 3, [2, 3, 5], None)
    assert all(got[x].pixels is None and got[x].failure for x in ("short", "text"))


def test_polygon_masks(spark):
    shapes = [("v", "a", 0, [[1.0, 1.0], [9.0, 2.0], [6.0, 11.0]]), ("v", "a", 1, [[12.0, 0.0], [20.0, 0.0], [20.0, 8.0], [12.0, 8.0]]), ("v", "a", 2, [[0.0, 0.0], [5.0, 5.0]]), ("w", "b", 0, [[-5.0, -5.0], [30.0, -5.0], [3.0, 30.0]]), ("w", "c", 0, [[50.0, 50.0], [60.0, 50.0], [60.0, 60.0]])]
    got = {tuple(r) for r in scenes.polygon_masks(spark.createDataFrame(shapes, "view string, category string, polygon_id long, points array<array<double>>"), (8, 10), (16, 20)).collect()}
    want = set()
    for view, category, _, points in shapes:
        if len(points) < 3:
            continue
        p = [(x / 2, y / 2) for x, y in points]
        for row in range(8):
            for col in range(10):
                inside = False
                for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
                    if (ay > row + 0.5) != (by > row + 0.5) and ax + (row + 0.5 - ay) * (bx - ax) / (by - ay) < col + 0.5:
                        inside = not inside
                if inside:
                    want.add((view, category, row, col))
    assert got == want and want


def test_metadata_is_carried_on(spark, tmp_path):
    path = f"file://{tmp_path}/meta"
    row = lambda *x: spark.createDataFrame(list(x), "run string, key string, value string")
    scenes.write_metadata(row(("r", "frames", "10"), ("r", "model", "m")), path)
    scenes.write_metadata(row(("r", "frames", "25"), ("q", "frames", "1")), path)
    assert {tuple(r) for r in scenes.read_metadata(spark, path).collect()} == {("r", "frames", "25"), ("r", "model", "m"), ("q", "frames", "1")}


def test_label_cache(spark, tmp_path):
    path = f"file://{tmp_path}/labels"
    labels = spark.createDataFrame([(1, 0), (2, -1)], "cell_id long, label long")
    scenes.write_labels(labels, path, "abc", 7, "hdbscan", {"min_size": 5})
    assert {tuple(r) for r in scenes.read_labels(spark, path, "abc").collect()} == {(1, 0), (2, -1)}
    with pytest.raises(ValueError, match="other features"):
        scenes.read_labels(spark, path, "abd")


def test_embeddings(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "instance_id long, vec array<double>")
    scenes.write_embeddings(rows, f"file://{tmp_path}/vec")
    assert spark.read.parquet(f"file://{tmp_path}/vec").count() == 2
    with pytest.raises(ValueError):
        scenes.write_embeddings(rows.union(rows), f"file://{tmp_path}/vec2")


def test_tables(spark):
    cells = spark.createDataFrame([(1, 2.0, "x"), (2, 3.0, None), (3, 4.0, "z")], "cell_id long, density double, tag string")
    assert names(scenes.gathered(cells, spark.createDataFrame([(3,), (3,), (1,)], "cell_id long")), "cell_id") == [1, 3]
    more = scenes.appended(cells, spark.createDataFrame([(4,)], "cell_id long"), {"density": F.lit(0)})
    assert more.columns == cells.columns and tuple(more.where("cell_id = 4").first()) == (4, 0.0, None)
    assert scenes.feature_block(cells, "density").columns == ["cell_id", "feat"]


def test_presets():
    own = {"pred_iou_thresh": 0.9, "min_area": 3}
    assert scenes.with_preset(own, "t70") == {"pred_iou_thresh": 0.7, "min_area": 3, "points_per_side": 32, "stability_thresh": 0.88}
    assert scenes.with_preset(own, None) == scenes.with_preset(own, "t10") == own


def test_best_views(spark):
    rows = [(1, v, area, visible, 100) for v, area, visible in [(0, 640, 50), (1, 320, 100), (2, 63, 100), (3, 64, 100), (4, 640, 0)]]
    got = [tuple(r) for r in scenes.best_views(spark.createDataFrame(rows, "instance_id long, view long, area long, visible long, total long"), 3).orderBy("rank").collect()]
    assert got == [(1, 0, 0.5, 1), (1, 1, 0.5, 2), (1, 3, 0.1, 3)]
