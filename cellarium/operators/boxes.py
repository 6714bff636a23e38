"""A hierarchy of axis-aligned boxes over points, used as an index (A31, F6, O1, J6): queries go down level by level, only into boxes
that may hold an answer.

Points are put in order along a Morton curve and numbered by counted ranges; LEAF neighbours in that order share a leaf, and
FAN boxes of one level a box of the next. A level of up to WIDE boxes is broadcast, as its size is bounded by that; lower
levels are joined by box.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.functions.scalar import morton
from cellarium.operators.graph import durable
from cellarium.sources.scenes import numbered

LEAF, FAN, WIDE, TILE = 32, 8, 4096, 8
SIDES = [f"{c}{k}" for c in "xyz" for k in (0, 1)]


def signed_distance(point: list[Column], low: list[Column], high: list[Column]) -> Column:
    """Distance of a point to a box: to its surface, negative inside."""
    over = [F.greatest(a - p, p - b) for p, a, b in zip(point, low, high, strict=True)]
    outside = F.sqrt(sum(F.greatest(o, F.lit(0.0)) * F.greatest(o, F.lit(0.0)) for o in over))
    return outside + F.least(F.greatest(*over), F.lit(0.0))


def nearest_in_box(point: list[Column]) -> Column:
    """Squared distance to the box x0..z1, 0 inside: a sphere meets the box if its squared radius is at least this."""
    return sum(F.pow(F.greatest(F.col(f"{c}0") - p, p - F.col(f"{c}1"), F.lit(0.0)), 2) for p, c in zip(point, "xyz", strict=True))


def farthest_in_box(point: list[Column]) -> Column:
    return sum(F.pow(F.greatest(p - F.col(f"{c}0"), F.col(f"{c}1") - p), 2) for p, c in zip(point, "xyz", strict=True))


@dataclass
class Boxes:
    points: DataFrame  # id, x, y, z, node: the leaf
    levels: list[DataFrame]  # of each level, leaves first: node, up (the box above), x0 .. z1
    sizes: list[int]


def built(points: DataFrame, leaf: int = LEAF) -> Boxes:
    """points: id, x, y, z, finite."""
    spans = points.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    low, side = [spans[2 * i] or 0.0 for i in range(3)], max([(spans[2 * i + 1] or 0.0) - (spans[2 * i] or 0.0) for i in range(3)]) or 1.0
    code = morton(*[F.floor((F.col(c) - low[i]) / side * 1023) for i, c in enumerate("xyz")])
    own = durable(numbered(points.select("id", *"xyz").withColumn("code", code), ["code", "id"], "k").withColumn("node", F.floor(F.col("k") / leaf)).drop("code", "k"))
    boxes = own.groupBy("node").agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))])
    levels, sizes = [], []
    while True:
        levels.append(durable(boxes.select("node", F.floor(F.col("node") / FAN).alias("up"), *SIDES)))
        sizes.append(levels[-1].count())
        if sizes[-1] <= FAN:
            return Boxes(own, levels, sizes)
        boxes = levels[-1].groupBy(F.col("up").alias("node")).agg(*[f(s).alias(s) for s in SIDES for f in (F.min if s[1] == "0" else F.max,)])


def descended(boxes: Boxes, queries: DataFrame, keep) -> DataFrame:
    """queries with the leaves `node` that `keep` leaves of them; keep takes rows with a box's sides, and gives the rows to follow."""
    names = queries.columns
    front = queries.crossJoin(F.broadcast(boxes.levels[-1]))  # at most FAN boxes
    for level in range(len(boxes.levels) - 1, -1, -1):
        front = keep(front).select(*names, "node")
        if level:
            below = boxes.levels[level - 1]
            below = F.broadcast(below) if boxes.sizes[level - 1] <= WIDE else below
            front = front.withColumnRenamed("node", "up").join(below, "up")
    return front


def within(boxes: Boxes, queries: DataFrame, leaves: int = TILE) -> DataFrame:
    """(q, id, d) of all points within r of each query (q, x, y, z, r).

    Tiles of `leaves` neighbouring leaves, with their box and their points as one array, meet the queries in a nested loop; a tile's
    points are unrolled beside a query only where the box allows it. Pairs are made in the task that gives them out and never
    shuffled. Where radii hold a fixed share of all points the result, and so the work, grows with the square of the table.
    """
    at = [F.col(f"q{c}") for c in "xyz"]
    sides = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    tiles = durable(boxes.points.groupBy(F.floor(F.col("node") / leaves).alias("tile")).agg(*sides, F.collect_list(F.struct("id", *"xyz")).alias("own")).drop("tile"))
    asked = durable(queries.select("q", *[F.col(c).alias(f"q{c}") for c in "xyz"], "r"))
    met = asked.crossJoin(tiles).where(nearest_in_box(at) <= F.col("r") * F.col("r") * (1 + 1e-12))
    met = met.select("q", "qx", "qy", "qz", "r", F.explode("own").alias("p"))
    d = F.sqrt(sum(F.pow(F.col(f"p.{c}") - F.col(f"q{c}"), 2) for c in "xyz"))
    return met.select("q", "p.id", d.alias("d"), "r").where("d <= r").drop("r")


def nearest(boxes: Boxes, queries: DataFrame) -> DataFrame:
    """(q, id, d) of the nearest point of each query (q, x, y, z); ties to the least id. A level's boxes that are farther than the
    farthest corner of another one can't hold it. A query has one row a box under way, so its windows are small."""
    at = [F.col(f"q{c}") for c in "xyz"]
    of = Window.partitionBy("q")

    def keep(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bound", F.min(farthest_in_box(at)).over(of)).where(nearest_in_box(at) <= F.col("bound") * (1 + 1e-12))

    leaves = descended(boxes, queries.select("q", *[F.col(c).alias(f"q{c}") for c in "xyz"]), keep)
    d = F.sqrt(sum(F.pow(F.col(c) - F.col(f"q{c}"), 2) for c in "xyz"))
    return leaves.join(boxes.points, "node").groupBy("q").agg(F.min(F.struct(d.alias("d"), "id")).alias("best")).select("q", "best.id", "best.d")
