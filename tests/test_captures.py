"""Binary captures and PLY text: round trips on files, and files that can't be read."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.sources import captures, ply


def camera_file(*cameras):
    return struct.pack("<Q", len(cameras)) + b"".join(struct.pack(f"<iiQQ{len(p)}d", i, m, w, h, *p) for i, m, w, h, p in cameras)


def view_file(rows):
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<i7di", i, *q, *t, 1) + name.encode() + b"\0" + struct.pack("<Q", k) + bytes(24 * k) for i, name, q, t, k in rows)


def point_file(rows):
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<Q3d3BdQ", i, *x, 1, 2, 3, 0.5, k) + bytes(8 * k) for i, x, k in rows)


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(1)
    views = [(i, f"b/ä{i}.jpg", rng.normal(size=4).tolist(), rng.normal(size=3).tolist(), i) for i in range(5)]
    for scene, folder in (("room", "sparse/0"), ("hall", "dslr/colmap"), ("bad", "sparse/0")):
        at = tmp_path / scene / folder
        at.mkdir(parents=True)
        (at / "cameras.bin").write_bytes(camera_file((1, 1, 6, 4, [5.0, 5.5, 3.0, 2.0]), *([(2, 0, 6, 4, [5.0, 3.0, 2.0])] if scene == "hall" else [])))
        (at / "images.bin").write_bytes(view_file(views)[: 90 if scene == "bad" else None])
        (at / "points3D.bin").write_bytes(point_file([(k, (k, 2.0, 3.0), k % 4) for k in range(25_000 if scene == "room" else 3)]))
    return f"file://{tmp_path}", views


def test_capture(spark, root):
    path, views = root
    files = captures.files(spark, path)
    rows, bad = captures.decoded(files, "images")
    assert [(r.scene, r.error[:10]) for r in bad.collect()] == [("bad", "ValueError")]
    got = {(r.scene, r.image_id): r for r in captures.posed(rows).collect()}
    assert got.keys() == {(s, i) for s in ("room", "hall") for i in range(5)}
    points, none = captures.decoded(files, "points3D")
    assert points.groupBy("scene").count().count() == 3 and points.where("scene = 'room'").agg(F.sum("x")).first()[0] == sum(range(25_000)) and not none.count()
    cameras, many = captures.single_cameras(captures.decoded(files, "cameras")[0])
    assert {r.scene for r in cameras.collect()} == {"room", "bad"} and [r.scene for r in many.collect()] == ["hall"]
    rays = {(r.i, r.j): np.array([r.dx, r.dy, r.dz]) for r in captures.view_rays(captures.posed(rows), cameras).where("image_id = 3").collect()}
    assert len(rays) == 24
    _, name, q, t, k = views[3]
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    v = got["room", 3]
    assert (v.name, v.observations) == (name, k) and np.allclose([v.x, v.y, v.z], -r.T @ t) and np.allclose(r @ r.T, np.eye(3))
    for (i, j), d in rays.items():
        own = np.array([(i + 0.5 - 3) / 5, (j + 0.5 - 2) / 5.5, 1])
        assert np.allclose(d, r.T @ own / np.linalg.norm(own))


def test_layouts_and_roots(spark, root):
    assert {tuple(r) for r in captures.layouts(spark, root[0]).collect()} == {("room", "pyramid"), ("bad", "pyramid"), ("hall", "dslr")}
    assert captures.image_folder("/d/", "room", "pyramid", 4) == "/d/room/images_4" and captures.image_folder("/d", "hall", "dslr", 2) == "/d/hall/dslr/resized_images"
    with pytest.raises(ValueError):
        captures.image_folder("/d", "room", "pyramid", 3)
    assert captures.resolved("lerf", {"LERF": "/a", "LERF_EXTRA": "/b:/c"}, "/data") == ["/a", "/data/lerf", "/b", "/c"]


def test_ply_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    cells = [(int(i), *map(float, rng.normal(size=3)), float(rng.random()), rng.normal(size=3).tolist(), rng.normal(size=2).tolist(), rng.normal(size=4).tolist()) for i in rng.permutation(70) * 3]
    near = sorted({(int(a) * 3, int(b) * 3) for a, b in rng.integers(0, 69, (90, 2)) if a != b} | {(int(b) * 3, int(a) * 3) for a, b in rng.integers(0, 69, (9, 2)) if a != b})
    path = f"file://{tmp_path}/scene"
    ply.write_ply(spark.createDataFrame(cells, "id long, x double, y double, z double, density double, dc array<double>, sh array<double>, feat array<double>"), spark.createDataFrame(near, "a long, b long").repartition(4), path)
    text = [x for f in sorted((tmp_path / "scene").glob("part-*")) for x in f.read_text().splitlines()]
    assert text[:3] == ["ply", "format ascii 1.0", "element vertex 70"] and text.index("end_header") + 70 + len(near) == len(text) - 1
    rows, found = ply.read_ply(spark, path)
    got = {r.vertex: r for r in rows.collect()}
    ends = np.cumsum([sum(a == 3 * i for a, _ in near) for i in range(70)])
    for i, *rest in cells:
        r = got[i // 3]
        assert np.allclose([r.x, r.y, r.z, r.density, r.color_sh_1, r.feat_3], [*rest[:4], rest[5][1], rest[6][3]], rtol=1e-6)
        assert [r.red, r.green, r.blue] == [int(np.clip(255 * (0.5 + ply.C0 * c), 0, 255)) for c in rest[4]] and r.adjacency_offset == ends[i // 3]
    assert sorted((r.a * 3, r.b * 3) for r in found.collect()) == near
    with pytest.raises(ValueError):
        ply.read_ply(spark, "/root/repo/README.md")
