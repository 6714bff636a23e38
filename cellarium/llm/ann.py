"""Operator 8, nearest neighbours by additive quantisation.

A vector is coded as the sum of one word from each of several codebooks of full dimension. The books are learnt on a
bounded sample, one after the other on what the former leave over, then all together by least squares; a beam search
chooses the words. The index holds codes, the norm of the coded vector, and the vector itself. A query looks up its
products with all words, sums them by code and divides by the stored norm. One scan of the codes finds each query's cut:
the `shortlist`-th best score of the whole table or, where that is lower, the (k + 1)-th best less twice the scores'
standard error. A second scan reranks exactly every row that reaches the cut. So what is reranked has one size at every
size of the table, but where more rows than that can't be told apart by their codes, as in a large group of near copies:
then all of these are reranked.
Queries come in blocks, one after the other, so that the driver holds one block's tables and cuts only; a block's
rows spread over tasks, and each task keeps k rows a query.

Of rows with equal vectors the index holds those of the k + 1 smallest ids: of k + 1 equal vectors at most one is the
query's own, so the others stand before any larger id. No row is lost by that from any result.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite components take no part; vectors of any finite
magnitude do, as both sides are scaled by their largest component; cosines are between vectors of one length, so each
length is searched by itself; a repeated vec_id is a candidate for each of its rows but never for its own id; ties go to
the smaller vec_id; with fewer candidates all are returned; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

SAMPLE, BOOKS, WORDS, BEAM = 8192, 16, 128, 4
QUERY_BLOCK, ROW_BLOCK, SHORTLIST = 4096, 4096, 256
CELLS, PAIRS = 1 << 21, 1 << 14  # scores, and pairs of vectors, that a task holds at a time


def usable(embeddings: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return embeddings.select(F.col("vec_id").cast("long"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & fine)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes by beam search: after each book the sums with the least error are kept."""
    m, k, d = books.shape
    flat, norms = books.reshape(m * k, d), (books**2).sum(2)
    gram = (flat @ flat.T).reshape(m, k, m, k)
    xb = (x @ flat.T).reshape(len(x), m, k)
    codes, err, each = np.zeros((len(x), 1, 0), np.int16), np.zeros((len(x), 1)), np.arange(len(x))[:, None]
    for j in range(m):
        cross = sum((gram[i][codes[:, :, i], j] for i in range(j)), np.zeros((*codes.shape[:2], k)))
        total = err[:, :, None] + norms[j] - 2 * xb[:, None, j] + 2 * cross
        total = total.reshape(len(x), -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (len(x), 1))
        codes = np.concatenate([codes[each, best // k], (best % k)[:, :, None].astype(np.int16)], axis=2)
        err = np.take_along_axis(total, best, 1)
    return codes[np.arange(len(x)), err.argmin(1)]


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 0) -> np.ndarray:
    """Codebooks for unit vectors x: residual k-means, then least squares over all books in turn with new codes."""
    rng = np.random.default_rng(seed)
    rest, out = x.copy(), np.zeros((books, words, x.shape[1]))
    for j in range(books):
        c = rest[rng.permutation(len(rest))[np.arange(words) % len(rest)]] * 0.5
        for _ in range(6):
            near = ((c**2).sum(1) - 2 * rest @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            s = np.zeros_like(c)
            np.add.at(s, near, rest)
            c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        out[j] = c
        rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
    for _ in range(2):
        codes = encode(x, out)
        hot = np.zeros((len(x), books * words), np.float32)
        hot[np.arange(len(x))[:, None], codes + np.arange(books) * words] = 1
        flat = np.linalg.solve((hot.T @ hot).astype(float) + 0.5 * np.eye(books * words), hot.T @ x + 0.5 * out.reshape(books * words, -1))
        out = flat.reshape(out.shape)
    return out


def build(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The index: a row for each vector, stored."""
    d = books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                codes = encode(units(x), books)
                norm = np.sqrt((sum(books[j][codes[:, j]] for j in range(len(books))) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norm), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "codes", "norm", "vector"])

    return stored(rows.mapInArrow(coded, "vec_id long, codes binary, norm double, vector binary"), "index")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, or of one with many, each scaled by its largest component so that no square leaves the range of doubles.

    Sums go in one order whatever the block, so that equal vectors tie.
    """
    q, x = q / np.abs(q).max(axis=-1, keepdims=True), x / np.abs(x).max(axis=-1, keepdims=True)
    return (x * q).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((q * q).sum(axis=-1)))


def blocks(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, ids, vectors, quantised scores of these queries with these rows), block by block."""
    step = max(1, CELLS // ROW_BLOCK)
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            n = part.num_rows
            vec = part.column(0).to_numpy()
            codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, -1)
            inverse = (1 / np.maximum(part.column(2).to_numpy(), 1e-9)).astype(np.float32)
            vectors = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(n, -1) if part.num_columns > 3 else np.empty(0)
            for q in range(0, len(table), step):
                score = table[q : q + step, 0][:, codes[:, 0]]
                for j in range(1, codes.shape[1]):
                    score += table[q : q + step, j][:, codes[:, j]]
                score *= inverse
                yield q, vec, vectors, score


def standard_error(x: np.ndarray, books: np.ndarray, pairs: int = 100_000) -> float:
    """How far quantised scores lie from cosines, measured on pairs of unit vectors x."""
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, len(x), (2, pairs))
    codes = encode(x, books)
    near = sum(books[b][codes[:, b]] for b in range(len(books)))
    near /= np.maximum(np.sqrt((near**2).sum(1, keepdims=True)), 1e-9)
    return float(np.sqrt(np.mean([(((x[a] * x[b]).sum(1) - (x[a] * near[b]).sum(1)) ** 2).mean() for a, b in zip(np.array_split(i, 10), np.array_split(j, 10), strict=True)])))


def cuts(index: DataFrame, table: np.ndarray, k: int, shortlist: int, slack: float) -> np.ndarray:
    """For each query the least quantised score that is reranked. Each task sends its best ones."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.full((len(table), shortlist), -np.inf, np.float32)
        for q, _, _, score in blocks(batches, table):
            own = np.concatenate([kept[q : q + len(score)], score], axis=1)
            kept[q : q + len(score)] = np.partition(own, own.shape[1] - shortlist, axis=1)[:, -shortlist:]
        for at in range(0, len(kept), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(at + 1024, len(kept))), pa.int64()), pa.array([k.tobytes() for k in kept[at : at + 1024]], pa.binary())], names=["q", "best"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([np.frombuffer(b, np.float32) for b in pdf["best"]])
        own = np.partition(own, (len(own) - shortlist, len(own) - k - 1))
        return pd.DataFrame({"q": pdf["q"].iloc[:1], "cut": [min(float(own[len(own) - shortlist]), float(own[len(own) - k - 1]) - slack)]})

    rows = index.select("vec_id", "codes", "norm").mapInArrow(best, "q long, best binary").groupBy("q").applyInPandas(merge, "q long, cut double").toPandas()
    out = np.full(len(table), -np.inf, np.float32)
    out[rows["q"].to_numpy(np.int64)] = rows["cut"].to_numpy(np.float32)
    return out


def search(index: DataFrame, ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, shortlist: int, slack: float) -> DataFrame:
    """The k nearest in each task's rows for a block of queries, of those rows that reach the queries' cuts."""
    table = np.einsum("qd,jwd->qjw", units(queries), books).astype(np.float32)
    cut = cuts(index, table, k, max(shortlist, k + 1), slack)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best, held, size = (none, none, np.empty(0)), [], 0

        def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, v, s = (np.concatenate([best[i], *[h[i] for h in held]]) for i in range(3))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            first = np.maximum.accumulate(np.where(np.concatenate(([True], q[1:] != q[:-1])), np.arange(len(q)), 0)) if len(q) else none
            keep = np.arange(len(q)) - first < k
            return q[keep], v[keep], s[keep]

        for at, vec, vectors, score in blocks(batches, table):
            q, r = np.nonzero(score >= cut[at : at + len(score), None])
            q, own = q + at, vec[r]
            other = own != ids[q]
            q, r, own = q[other], r[other], own[other]
            for i in range(0, len(q), PAIRS):
                held.append((q[i : i + PAIRS], own[i : i + PAIRS], exact(queries[q[i : i + PAIRS]], vectors[r[i : i + PAIRS]])))
                size += len(held[-1][0])
                if size > 64 * PAIRS:
                    best, held, size = settle(), [], 0
        q, v, s = settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(found, "query_id long, vec_id long, score double")


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows with the k + 1 smallest ids, and k of each. Spark cuts groups down before the shuffle, so copies don't gather."""
    rows = rows.withColumn("hash", F.xxhash64("embedding"))
    same = Window.partitionBy("hash", "embedding")
    rows = rows.withColumn("place", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("place") <= k + 1)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("hash", "embedding", "vec_id").orderBy("vec_id"))).where(F.col("again") <= k)
    return rows.select("vec_id", "embedding")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, shortlist: int = SHORTLIST) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by `every`, by cosine.

    sample: most vectors that the codebooks are learnt from, those with the smallest hash of their id. shortlist: how
    many rows a query compares exactly, besides those that tie with the last; more of them raise the recall.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    path, asked_any = scratch(spark, "nearest"), False
    for d in sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect()):
        own = rows.where(F.size("embedding") == d)
        learn = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"]
        learn = np.array(learn.to_pylist(), float)
        books = train(units(learn), words=min(WORDS, max(2, len(learn) // 8)))
        slack = 2 * standard_error(units(learn), books)
        index = build(distinct_enough(own, k), books)
        asked = own.where(F.col("vec_id") % every == 0).distinct()
        parts = max(1, -(-asked.count() // QUERY_BLOCK))
        for b in range(parts):  # a block holds some QUERY_BLOCK queries, whatever the table's size, and is done before the next
            some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b).toPandas().sort_values("vec_id")
            if len(some):
                one = search(index, some["vec_id"].to_numpy(), np.array(some["embedding"].tolist(), float).reshape(len(some), -1), books, k, shortlist, slack)
                one.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k).write.mode("append").parquet(path)
                asked_any = True
    schema = "query_id long, rank int, vec_id long, score double"
    return spark.read.schema(schema).parquet(path) if asked_any else spark.createDataFrame([], schema)
