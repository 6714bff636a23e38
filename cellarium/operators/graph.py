"""Connected components and what is built on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SMALL = 10_000  # rows that may go through the driver


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names; a session that runs in one process may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a written table in the cluster's shared folder; the rows are computed once."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(side: DataFrame, rows: float) -> DataFrame:
    """side, of at most so many rows, for a join: broadcast up to SMALL, merged beyond.

    Left to itself Spark goes by the size of files, in which unrolled and well compressed rows count for little, and sends them
    through the driver.
    """
    return F.broadcast(side) if rows <= SMALL else side.hint("merge")


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp): comp is the component's least id. nodes: id; edges: u, v.

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked to the smallest of the
    neighbourhood, until no link changes. Links shrink towards one a node; a round writes one table and brings two
    numbers to the driver, and rounds grow with the logarithm of the longest path.
    """
    links = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, n = None, links.count()  # each node has a link, so there are at most twice as many
    for _ in range(rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(beside(least, 2 * n), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(beside(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = durable(small.union(least).where("u <> v").distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp"))
    return nodes.select("id").distinct().join(beside(roots, 2 * n), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def relabel(components: DataFrame, min_size: int) -> DataFrame:
    """Components smaller than min_size become -1, the others are numbered from 0 in ascending order."""
    kept = components.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    ids = kept.select("comp", (F.dense_rank().over(Window.orderBy("comp")) - 1).alias("label"))
    return components.join(ids.hint("merge"), "comp", "left").select("id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def threshold_components(nodes: DataFrame, edges: DataFrame, tau: float, min_size: int = 1) -> DataFrame:
    """Components over edges (u, v, d) with d strictly below tau."""
    return relabel(connected_components(nodes, edges.where(F.col("d") < tau)), min_size)


def split_connected(labels: DataFrame, edges: DataFrame, min_size: int = 1) -> DataFrame:
    """Each label (id, label) is split where same-label edges don't connect it; noise stays noise."""
    a, b = labels.select(F.col("id").alias("u"), F.col("label").alias("la")), labels.select(F.col("id").alias("v"), F.col("label").alias("lb"))
    inner = edges.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where("la = lb and la >= 0").select("u", "v")
    parts = connected_components(labels.where("label >= 0").select("id"), inner)
    out = relabel(parts, max(min_size, 1))
    return labels.select("id").join(out.hint("merge"), "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def grown(shell: DataFrame, edges: DataFrame) -> DataFrame:
    """The shell and its one-ring."""
    near = [edges.join(shell.select(F.col("id").alias(a)).hint("merge"), a, "left_semi").select(F.col(b).alias("id")) for a, b in (("u", "v"), ("v", "u"))]
    return shell.select("id").union(near[0]).union(near[1]).distinct()


def volume(shell: DataFrame, cells: DataFrame, edges: DataFrame, pad: float = 0.12, margin: float = 0.02) -> DataFrame:
    """(id, part, leaks): an object's cells, part `shell` or `interior`. leaks: the box has free cells and none is enclosed, so the shell has holes."""
    inside = durable(enclose(shell, cells, edges, pad, margin))
    closed = inside.limit(1).count() > 0
    rows = shell.select("id", F.lit("shell").alias("part")).union(inside.select("id", F.lit("interior").alias("part")))
    return rows.withColumn("leaks", F.lit(not closed))


def enclose(shell: DataFrame, cells: DataFrame, edges: DataFrame, pad: float = 0.12, margin: float = 0.02) -> DataFrame:
    """Cells inside a shell: free cells of the padded box whose free component doesn't reach the box's margin. shell: id; cells: id, x, y, z."""
    core = cells.join(shell.hint("merge"), "id", "left_semi")
    box = core.agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, 0), (F.max, 1))])
    inside, edge = F.lit(True), F.lit(False)
    for c in "xyz":
        size = F.col(f"{c}1") - F.col(f"{c}0")
        lo, hi = F.col(f"{c}0") - pad * size, F.col(f"{c}1") + pad * size
        inside &= F.col(c).between(lo, hi)
        edge |= (F.col(c) <= lo + margin * size) | (F.col(c) >= hi - margin * size)
    free = cells.join(F.broadcast(box)).where(inside).join(shell.hint("merge"), "id", "left_anti").select("id", edge.alias("edge"))
    own = edges.join(free.select(F.col("id").alias("u")).hint("merge"), "u", "left_semi").join(free.select(F.col("id").alias("v")).hint("merge"), "v", "left_semi")
    parts = connected_components(free.select("id"), own).join(free.hint("merge"), "id")
    outside = parts.groupBy("comp").agg(F.max("edge").alias("outside"))
    return parts.join(outside.hint("merge"), "comp").where(~F.col("outside")).select("id")
