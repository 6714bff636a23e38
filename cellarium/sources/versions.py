"""Derived tables that know what they were made from, and are made anew when that changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.operators.graph import durable


def version(rows: DataFrame) -> tuple:
    """Row count and a sum of row hashes, in no order: one aggregation, and equal for equal tables however they are stored."""
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())


@dataclass
class Kept:
    """A derived table by name; `get` returns it as long as its sources' version is the one it was made from."""

    tables: dict[tuple, tuple[tuple, DataFrame]] = field(default_factory=dict)

    def get(self, name: tuple, sources: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        now = version(sources)
        held = self.tables.get(name)
        if held is None or held[0] != now:
            held = self.tables[name] = now, durable(make())
        return held[1]


@dataclass
class Topology:
    """What occupancy losses read of a neighbour graph: undirected edges with the square of their length as weight of the face
    between them, and each cell's extent, half the mean distance to its neighbours (0 without any).

    It is made anew when the number of cells or of directed edges changes, and after `every` uses in any case: a graph that
    was rebuilt may keep the number of cells, and cells may drift while both numbers stay.
    """

    every: int = 250
    made_from: tuple[int, int] | None = None
    age: int = 0
    edges: DataFrame | None = None
    extent: DataFrame | None = None

    def refresh(self, cells: DataFrame, adjacency: DataFrame) -> bool:
        """cells: id, x, y, z; adjacency: a, b in both directions. Says whether the tables were made anew."""
        now = cells.count(), adjacency.count()
        if now == self.made_from and self.age < self.every:
            self.age += 1
            return False
        ends = adjacency.where("a < b").distinct()
        for end in "ab":
            ends = ends.join(cells.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}{c}") for c in "xyz"]), end)
        d = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"))
        self.edges = durable(ends.select(F.col("a").alias("u"), F.col("b").alias("v"), d.alias("d")).withColumn("face_weight", F.col("d") * F.col("d")))
        each = self.edges.select(F.col("u").alias("id"), "d").union(self.edges.select("v", "d")).groupBy("id").agg((F.sum("d") / F.count(F.lit(1)) / 2).alias("extent"))
        self.extent = durable(cells.select("id").join(each, "id", "left").fillna(0.0, ["extent"]))
        self.made_from, self.age = now, 0
        return True
