"""Shared helpers: the cluster's scratch folder, durable intermediate tables, and text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BROADCAST_ROWS, BROADCAST_BYTES, SALTS, HEAVY = 200_000, 16 << 20, 16, 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names, which driver and executors share.

    Where the setting is absent, a session that runs in one process makes and sets a local folder; a cluster's fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage is cut, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether df has at most BROADCAST_ROWS rows and these, written as JSON, at most BROADCAST_BYTES."""
    n, written = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= BROADCAST_ROWS and written <= BROADCAST_BYTES


def meet(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with a side that has a size of its own, such as a benchmark's: broadcast behind a check of its size.

    Beyond that both are dealt out by key and salt, so that no key's rows meet in one task.
    """
    if is_small(side):
        return rows.join(F.broadcast(side), on)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    salted = side.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", salt).join(salted.hint("merge"), [*on, "_salt"]).drop("_salt")


def skewed(rows: DataFrame, side: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """rows joined with side, one row a key, whose column `weight` counts the rows of each key, of `total` in all.

    Keys with more than one in HEAVY of all rows, which are fewer than HEAVY keys, are broadcast; the others are shuffled. Where
    there is none, one join does it. side is read up to three times: stored, if it isn't cheap.
    """
    heavy = side.where(F.col(weight) * HEAVY > total)
    if not heavy.limit(1).count():
        return rows.join(side.hint("merge"), on)
    light = side.where(F.col(weight) * HEAVY <= total).hint("merge")
    often = rows.join(F.broadcast(heavy), on)
    return often.unionByName(rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
