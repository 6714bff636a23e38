"""Density clustering within a radius (J12, G12) and the cluster cache's fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.operators.graph import connected_components


def within(points: DataFrame, eps: float, by: str | None = None) -> DataFrame:
    """Pairs (a, b, d) of points (id, x, y, z) at distance eps or less, themselves included.

    Points meet in grid buckets of width eps: one side in its own, the other in the 27 around it. by: both in the same group.
    """
    cell = [F.floor(F.col(c) / eps).alias(f"g{c}") for c in "xyz"]
    keys = ["gx", "gy", "gz"] + ([by] if by else [])
    own = points.select("*", *cell)
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = own
    for c in "xyz":
        near = near.select("*", steps.alias("s")).withColumn(f"g{c}", F.col(f"g{c}") + F.col("s")).drop("s")
    a = own.select(F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *keys)
    b = near.select(F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *keys)
    d = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"))
    return a.join(b, keys).select("a", "b", d.alias("d")).where(F.col("d") <= eps)


def dbscan(points: DataFrame, eps: float = 0.5, min_points: int = 5, by: str | None = None) -> DataFrame:
    """(id, cluster): the least core id of the cluster, null for noise. A border point goes to the least cluster among its cores."""
    pairs = within(points, eps, by)
    core = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("id"))
    inner = pairs.join(core.select(F.col("id").alias("a")), "a", "left_semi").join(core.select(F.col("id").alias("b")), "b", "left_semi")
    comps = connected_components(core, inner.select(F.col("a").alias("u"), F.col("b").alias("v")))
    reach = pairs.join(comps.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("reached"))
    out = points.select("id").join(comps, "id", "left").join(reach, F.col("id") == F.col("a"), "left")
    return out.select("id", F.coalesce("comp", "reached").alias("cluster"))


def fingerprint(cells: DataFrame, rows: int = 4096) -> str:
    """A digest of a feature table's size and at most `rows` evenly spaced rows, by which a cached clustering is known to fit."""
    from cellarium.sources.scenes import numbered

    n = cells.count()
    picked = numbered(cells.select("id", "feat"), ["id"], "r").where(F.col("r") % max(1, -(-n // rows)) == 0)
    lines = picked.select(F.concat_ws(",", F.col("id").cast("string"), F.transform("feat", lambda x: x.cast("string"))).alias("x"), "id")
    return lines.agg(F.sha1(F.concat(F.lit(f"{n};"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda s: s["x"]), ";")).cast("binary")).alias("h")).first()[0]
