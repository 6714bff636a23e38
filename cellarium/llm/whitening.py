"""Operator 11, whitening of embeddings by upper-triangle column aggregates.

Entries c become longs x = floor(1024 * c) + 100000. One aggregation sums every dimension exactly, as decimals; a second
one, of generated SQL expressions, sums the centred products of every pair of dimensions of the upper triangle. The driver
gets that one row, assembles the covariance (divisor n) and decomposes it with LAPACK; rows are then projected on the
leading components in SQL. What the driver holds has the size of one covariance matrix, whatever the number of rows.
An aggregation holds at most PAIRS products, so that its plan stays bounded: vectors of 64 dimensions need one, of 768
dimensions 73, each of which reads the vectors once.

Centred entries are (x - q) - r / n with S = q * n + r: the difference of longs is exact, however large the entries are.

Edge cases: vectors that are null or hold null, NaN or infinite entries take no part; entries beyond 2^60 / 1024 in size
count as that bound; vectors of one length are fitted by themselves, n and all other figures being those of their length;
empty vectors have no component and give no row. A component whose eigenvalue is zero but for rounding has no whitened
value and gives no row, so a single vector, or equal ones, give none. deviation is null where it passes 64 bits. Repeated
rows and ids count and are returned as often as they occur, null ids too; an empty table gives no row; further columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 60)
PAIRS = 4096


def quantised(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x (array of long) of the vectors that take part."""
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + SHIFT)
    return rows.where(c.isNotNull() & finite).select(F.col(f"`{id_column}`").alias("id"), whole.alias("x"))


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension of x."""
    got = rows.agg(F.count(F.lit(1)), *[F.expr(f"sum(cast(x[{i}] as decimal(20,0)))") for i in range(d)]).first()
    return got[0], [int(s or 0) for s in got[1:]]


def centred(n: int, s: list[int], column: str = "x") -> Column:
    """x less its mean S / n, as doubles."""
    whole = F.array(*[F.lit(v // n) for v in s])
    rest = F.array(*[F.lit((v % n) / n) for v in s])
    return F.zip_with(F.zip_with(column, whole, lambda v, q: (v - q).cast("double")), rest, lambda v, r: v - r)


def products(rows: DataFrame, column: str, d: int) -> np.ndarray:
    """Symmetric matrix of the sums of column[i] * column[j], by one aggregation for each PAIRS pairs."""
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for k in range(0, len(upper), PAIRS):
        part = upper[k : k + PAIRS]
        got = rows.agg(*[F.expr(f"sum({column}[{i}] * {column}[{j}])") for i, j in part]).first()
        for (i, j), v in zip(part, got, strict=True):
            out[i, j] = out[j, i] = v or 0.0
    return out


@dataclass
class Model:
    """What is learnt from vectors of one length: components are columns, in order of falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def whitened(self) -> Column:
        """Array of the projections of x on each component, over the square root of its eigenvalue."""
        c = centred(self.n, self.sums)
        along = self.components / np.sqrt(self.eigenvalues)
        dot = lambda w: F.aggregate(F.zip_with(c, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.array(*[dot(along[:, k].tolist()) for k in range(along.shape[1])])

    def deviation(self) -> Column:
        """Sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
        far = F.zip_with("x", F.array(*[F.lit(v // self.n) for v in self.sums]), lambda v, q: F.try_multiply(v - q, F.lit(self.n)))
        far = F.zip_with(far, F.array(*[F.lit(v % self.n) for v in self.sums]), lambda v, r: F.try_subtract(v, r))
        return F.aggregate(F.transform(far, lambda v: F.try_multiply(v, v)), F.lit(0).cast("long"), lambda s, v: F.try_add(s, v))


def fit(rows: DataFrame, d: int, most: int) -> Model:
    """rows: x, all of length d. At most `most` components are kept, and none whose eigenvalue is zero but for rounding."""
    n, s = sums(rows, d)
    cov = products(rows.select(centred(n, s).alias("c")), "c", d) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:most] > max(values[0], 0.0) * d * np.finfo(float).eps * 16).sum())
    return Model(n, s, values[:kept], vectors[:, :kept], float(np.trace(cov)))


def identity_error(rows: DataFrame, column: str, k: int, n: int) -> float:
    """Largest absolute entry of the column's covariance less the identity, over rows as they are."""
    means = rows.agg(*[F.expr(f"avg({column}[{i}])") for i in range(k)]).first()
    less = F.zip_with(column, F.array(*map(F.lit, means)), lambda v, m: v - m)
    return float(np.abs(products(rows.select(less.alias("c")), "c", k) / n - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = 8, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, n, deviation, whitened (array), explained (array), identity_error of each vector that takes part."""
    rows = quantised(embeddings, id_column, vector)
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().where("`size(x)` > 0").collect())
    out = None
    for d in lengths:
        own = rows.where(F.size("x") == d)
        model = fit(own, d, most)
        k = len(model.eigenvalues)
        if not k:
            continue
        found = stored(own.select("id", model.deviation().alias("deviation"), model.whitened().alias("whitened")), "whitened")
        shares = F.array(*map(F.lit, (model.eigenvalues / model.trace).tolist()))
        found = found.select("id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(identity_error(found, "whitened", k, model.n)).alias("identity_error"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        nothing = F.array().cast("array<double>")
        out = rows.where("false").select("id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), nothing.alias("whitened"), nothing.alias("explained"), F.lit(0.0).alias("identity_error"))
    return out
