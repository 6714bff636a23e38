"""Exact nearest points by a grid (J5-J7, J9, J20): cells are searched around each query, wider where too few are near."""

from __future__ import annotations

from math import inf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cellarium.operators.graph import beside, durable


def spans(*tables: DataFrame) -> tuple[list[float], float, int]:
    """(least corner, largest side) of the box around the tables' points, and the rows of the first table."""
    got = [t.agg(F.count(F.lit(1)), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first() for t in tables]
    n, got = got[0][0], [g for g in got if g[0]]
    if not n:
        return [0.0] * 3, 0.0, 0
    low, high = [min(g[1 + 2 * i] for g in got) for i in range(3)], [max(g[2 + 2 * i] for g in got) for i in range(3)]
    return low, max(b - a for a, b in zip(low, high, strict=True)), n


def at(c: str, low: float, width: float):
    return F.floor((F.col(c) - low) / width)


def nearest(points: DataFrame, queries: DataFrame, k: int = 1, crowd: int = 4) -> DataFrame:
    """(q, id, d, rank) of the k nearest points (id, x, y, z) of each query (q, x, y, z), ties by id. All points, if fewer.

    Points of one place are one row with their k least ids, and queries of one place are asked once, so copies cost nothing; the
    k nearest points are among those of the k nearest places. In a grid of width w all places within w of a query lie in the 27
    cells around it, so k points found within w are the nearest. Queries without them are asked again at twice the width; the
    first width leaves at most `crowd` * k places in a cell where halving it helps, so that crowded places cost no more than others.
    """
    spark = points.sparkSession
    schema = StructType([queries.schema["q"], points.schema["id"], StructField("d", DoubleType()), StructField("rank", IntegerType())])
    low, side, n = spans(points, queries)
    if not n:
        return spark.createDataFrame([], schema)
    least = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("id"))
    places = points.select("id", *"xyz").withColumn("k", least).where(F.col("k") <= k).groupBy("x", "y", "z").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    places = durable(places)
    n = places.count()
    width = (side or 1.0) / max(1.0, (n / (2 * k)) ** (1 / 3))
    before = inf
    while True:
        most = places.groupBy(*[at(c, low[i], width) for i, c in enumerate("xyz")]).count().agg(F.max("count")).first()[0]
        if most <= crowd * k or most >= before and width < side / n:
            break
        before, width = most, width / 2
    found, left = [], durable(queries.select(*"xyz").distinct())
    asked = m = left.count()
    while True:
        last = width > 2 * side
        own = places.select("ids", *[F.col(c).alias(f"p{c}") for c in "xyz"], *[at(c, low[i], width).alias(f"g{c}") for i, c in enumerate("xyz")])
        near = left
        for i, c in enumerate("xyz"):
            near = near.withColumn(f"g{c}", F.explode(F.sequence(at(c, low[i], width) - 1, at(c, low[i], width) + 1)))
        d = F.sqrt(sum(F.pow(F.col(c) - F.col(f"p{c}"), 2) for c in "xyz"))
        near = near.join(beside(own, n), ["gx", "gy", "gz"]).select(*"xyz", "ids", d.alias("d"))
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*"xyz").orderBy("d", F.col("ids")[0]))).where(F.col("rank") <= k).drop("rank")
        near = durable(near)
        if last:
            found.append(near)
            break
        done = near.where(F.col("d") <= width).groupBy(*"xyz").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= k).drop("n")
        done = durable(done)
        found.append(near.join(beside(done, m), [*"xyz"], "left_semi"))
        left = durable(left.join(beside(done, m), [*"xyz"], "left_anti"))
        m = left.count()
        if not m:
            break
        width *= 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = out.select(*"xyz", "d", F.explode("ids").alias("id"))
    out = durable(out.withColumn("rank", F.row_number().over(Window.partitionBy(*"xyz").orderBy("d", "id"))).where(F.col("rank") <= k))
    return queries.select("q", *"xyz").join(beside(out, k * asked), [*"xyz"]).select("q", "id", "d", "rank")


def neighbours(cells: DataFrame, k: int = 6) -> DataFrame:
    """(a, b, d): the k nearest other cells of each cell (id, x, y, z)."""
    got = nearest(cells, cells.withColumnRenamed("id", "q"), k + 1).where("q <> id")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return got.withColumn("k", place).where(F.col("k") <= k).select(F.col("q").alias("a"), F.col("id").alias("b"), "d")
