"""Scenes as PLY text: a header, the cells, then the neighbour list (K1).

Rows are numbered by counted ranges and leave as ordered lines through Spark's text sink, whose committer publishes a write
as a whole or not at all; its parts, in order of their names, are one PLY file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.graph import durable
from cellarium.sources.scenes import numbered

# Fixed value: the constant of the zeroth spherical harmonic.
C0 = 0.28209479177387814


def running(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value up to and with each row in an order, by ranges: only one sum a range comes to the driver."""
    from pyspark.sql import Window

    own = durable(numbered(rows, order, "_n").withColumn("_range", F.floor(F.col("_n") / 10_000)))
    sums = sorted(map(tuple, own.groupBy("_range").agg(F.sum(value)).collect()))
    before, table = 0, []
    for part, n in sums:
        table.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(table or [(0, 0)], "_range long, _before long")
    within = F.sum(value).over(Window.partitionBy("_range").orderBy("_n"))
    return own.join(offsets, "_range").withColumn(name, (within + F.col("_before")).cast("long")).drop("_n", "_range", "_before")


def byte(c: Column) -> Column:
    return F.floor(F.least(F.greatest(255 * (0.5 + C0 * c), F.lit(0.0)), F.lit(255.0))).cast("int")


def columns(sh: int, features: int) -> list[tuple[str, str]]:
    """Names and types of a cell's properties, in the file's order."""
    return [*[(c, "float") for c in "xyz"], *[(c, "uchar") for c in ("red", "green", "blue")], ("density", "float"), ("adjacency_offset", "uint"), *[(f"color_sh_{i}", "float") for i in range(sh)], *[(f"feat_{i}", "float") for i in range(features)]]


def vertices(cells: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Cells in order of id with `vertex`, their number from 0, quantised colour and `adjacency_offset`, the end of their neighbours.

    cells: id, x, y, z, density, dc (array of 3), sh (array), feat (array); adjacency: a, b in both directions.
    """
    degree = adjacency.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    rows = numbered(cells, ["id"], "vertex").join(degree, "id", "left").fillna(0, ["degree"])
    rows = running(rows, ["vertex"], "degree", "adjacency_offset")
    return rows.withColumns({c: byte(F.col("dc")[i]) for i, c in enumerate(("red", "green", "blue"))}).drop("degree")


def write_ply(cells: DataFrame, adjacency: DataFrame, path: str) -> None:
    rows = durable(vertices(cells, adjacency))
    n, edges = rows.count(), adjacency.count()
    sizes = rows.select(F.size("sh"), F.size("feat")).limit(1).collect()
    sh, features = sizes[0] if sizes else (0, 0)
    names = columns(sh, features)
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property {t} {c}" for c, t in names], f"element adjacency {edges}", "property uint adjacency", "end_header"]
    values = [F.col(c) for c, _ in names[:8]] + [F.col("sh")[i] for i in range(sh)] + [F.col("feat")[i] for i in range(features)]
    real = lambda c, t: c.cast("float").cast("string") if t == "float" else c.cast("string")
    spark = cells.sparkSession
    top = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(head)], "part int, a long, b long, value string")
    body = rows.select(F.lit(1).alias("part"), F.col("vertex").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", *[real(v, t) for v, (_, t) in zip(values, names, strict=True)]).alias("value"))
    index = rows.select("id", "vertex")
    near = adjacency.join(index.select(F.col("id").alias("a"), F.col("vertex").alias("va")), "a").join(index.select(F.col("id").alias("b"), F.col("vertex").alias("vb")), "b")
    tail = near.select(F.lit(2).alias("part"), F.col("va").alias("a"), F.col("vb").alias("b"), F.col("vb").cast("string").alias("value"))
    top.union(body).union(tail).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b").select("value").write.text(path)


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertex and its properties as doubles or longs, (a, b) of the neighbour list by vertices' numbers)."""
    lines = spark.read.text(path).select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("_at"))
    lines = durable(numbered(lines, ["file_name", "_at"], "line"))
    first = lines.where("value = 'end_header'").agg(F.min("line")).first()[0]
    if first is None:
        raise ValueError(f"{path} has no PLY header")
    head = [r.value.split() for r in lines.where(F.col("line") < first).orderBy("line").collect()]
    n = next(int(h[2]) for h in head if h[:2] == ["element", "vertex"])
    names = [(h[2], h[1]) for h in head if h[0] == "property" and h[2] != "adjacency"]
    body = lines.where(F.col("line").between(first + 1, first + n)).select((F.col("line") - first - 1).alias("vertex"), F.split("value", " ").alias("v"))
    cells = body.select("vertex", *[F.col("v")[i].cast("double" if t == "float" else "long").alias(c) for i, (c, t) in enumerate(names)])
    entries = lines.where(F.col("line") > first + n).select((F.col("line") - first - n - 1).alias("k"), F.col("value").cast("long").alias("b"))
    ends = cells.select("vertex", F.col("adjacency_offset").alias("stop"))
    starts = ends.select((F.col("vertex") + 1).alias("vertex"), F.col("stop").alias("start"))
    spans = ends.join(starts, "vertex", "left").fillna(0, ["start"]).where("stop > start")
    return cells, spans.select(F.col("vertex").alias("a"), F.explode(F.expr("sequence(start, stop - 1)")).alias("k")).join(entries, "k").select("a", "b")
