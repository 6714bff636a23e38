"""Searches of query vectors against all vectors, block by block.

Vectors are dealt into blocks of BLOCK rows; each block of queries meets each block of candidates as two matrices in one
task, so no pair is a row and nothing but a block's answers leaves a task. All pairs are compared: the work is quadratic, but
bounded in memory and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.operators.graph import durable

BLOCK, SLICE = 8192, 512
SLACK = 1e-8  # by which products in another order of summation, and rounding to 9 digits, may differ


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, n, ids, label, feat): rows (id, label, feat) as blocks of at most `block`, each of whole arrays' bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                feat = np.stack(part["feat"].to_numpy()).astype(float)
                yield pd.DataFrame({"n": [len(part)], "ids": [part["id"].to_numpy(np.int64).tobytes()], "label": [part["label"].to_numpy(np.int64).tobytes()], "feat": [feat.tobytes()]})

    return durable(rows.select("id", F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), "feat").mapInPandas(pack, "n int, ids binary, label binary, feat binary"))


def against(queries: DataFrame, candidates: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """What `answer` (query ids, candidate ids, labels, products) gives for each pair of blocks; queries' products by slices."""
    q = blocks(queries).select(F.col("n").alias("qn"), F.col("ids").alias("q"), F.col("feat").alias("qf"))
    c = blocks(candidates)
    pairs = q.repartition(q.sparkSession.sparkContext.defaultParallelism * 2).crossJoin(c)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q, ids, label = (np.frombuffer(x, np.int64) for x in (r.q, r.ids, r.label))
                x, y = np.frombuffer(r.qf).reshape(r.qn, -1), np.frombuffer(r.feat).reshape(r.n, -1)
                for at in range(0, len(q), SLICE):
                    yield answer(q[at : at + SLICE], ids, label, x[at : at + SLICE] @ y.T)

    return pairs.mapInPandas(go, schema)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(q, id, rank, s): of each query (id, feat) the k candidates (id, feat) with the largest products, as rounded to 9 digits; ties
    by id. A block gives all that may be among them; the last choice is by products that are summed in order."""

    def answer(q: np.ndarray, ids: np.ndarray, label: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        order = np.argsort(ids, kind="stable")
        ids, s = ids[order], s[:, order]
        n = min(k, len(ids))
        low = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero(s >= low[:, None] - SLACK)
        # of equal vectors, which have equal products, the k with the least ids are enough
        d = pd.DataFrame({"i": i, "s": s[i, j], "q": q[i], "id": ids[j]})
        return d[d.groupby(["i", "s"]).cumcount() < k][["q", "id"]]

    asked = queries.select("id", "feat", F.lit(-1).alias("label"))
    found = durable(against(asked, candidates.select("id", "feat", F.lit(-1).alias("label")), answer, "q long, id long"))
    rows = found.join(queries.select(F.col("id").alias("q"), F.col("feat").alias("qf")), "q").join(candidates.select("id", "feat"), "id").select("q", "id", dot("qf", "feat").alias("s"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "id", "rank", "s")


def best_by_label(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q, label, best): the largest product of each query (id, feat) with a label's candidates (id, feat, label)."""

    def answer(q: np.ndarray, ids: np.ndarray, label: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        order = np.argsort(label, kind="stable")
        names, first = np.unique(label[order], return_index=True)
        best = np.maximum.reduceat(s[:, order], first, axis=1)
        return pd.DataFrame({"q": np.repeat(q, len(names)), "label": np.tile(names, len(q)), "best": best.ravel()})

    found = against(queries.select("id", "feat", F.lit(-1).alias("label")), candidates, answer, "q long, label long, best double")
    return found.groupBy("q", "label").agg(F.max("best").alias("best"))


def mean_by_label(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q, label, s): the mean product of each query (id, feat) with a label's candidates, which is that with their mean vector."""
    parts = candidates.select("label", F.posexplode("feat").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = durable(parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean")))
    return queries.select(F.col("id").alias("q"), "feat").crossJoin(mean).select("q", "label", dot("feat", "mean").alias("s"))
