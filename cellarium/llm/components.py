"""Connected components of a link table by alternating stars, in the DataFrame API.

Each round makes two aggregations and joins. Hubs, whose neighbours are many, meet their minimum by a broadcast of fewer
than HEAVY rows; the others by a shuffle. Neighbourhoods' minima are stored, so that a
round's plans stay small: plans and their broadcasts are what the driver holds. Four numbers a round come to it. Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skewed, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has a link. links: columns a, b."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state, n = None, edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "low")
        # large star: each larger neighbour is linked to the smallest of the neighbourhood
        large = skewed(both, low, "u", "n", 2 * n).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "stars")
        # small star: each smaller neighbour, and the node, likewise
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = skewed(large, low, "u", "n", n)
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select("root", "root").distinct())
