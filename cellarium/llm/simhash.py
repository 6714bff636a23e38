"""Operator 3, SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits are 32 segments of two bits; its image is the point of the segments' numbers of ones, 0 to 2. The
Manhattan distance of two images is at most the Hamming distance of the fingerprints. The grid range join: the segments
form few groups, and in one of them at least the points of a linked pair lie within distance one (of 4 over 3 groups), so
one of the pair lies in the other's grid cell of that group or in one of the cells next to it along a segment's axis.
Then the Manhattan distance over all segments rules pairs out, and differing bits are counted. Equal fingerprints are one row
throughout, so copies are never paired. Each cell is first compared with a few of its own rows; what these leave in
different components is then compared pair by pair, so that a large group of near copies gives few links.

Edge cases: a null text has no words; no words: fingerprint zero, linked like any other; fewer words than a shingle
has: the whole sequence; a null doc_id takes part but is no component's id unless all of it are null (then null);
repeated rows are returned each; an empty table gives no row; further columns are not read.

Joins whose sides grow with the corpus are merged at every size: Spark sizes a table by its files, where unrolled cells (some 70
a fingerprint) and rows that compress well count for little, and would send them through the driver as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import skewed, stored
from .components import components

LOW = 0x5555555555555555
CENTRES, BLOCK = 4, 1 << 16


def bits_set(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """A-Z lower-cased, words between white space; a bit is 1 if set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < words:
        return xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, w), np.int64, len(w))
    stop = np.cumsum(size + 1) - 1
    first, last = (stop - size)[: len(w) - words + 1].tolist(), stop[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        ones += bits_set(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], "<u8"))
    return majority(ones, len(first))


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(rows, "doc_id long, h long, fp long")


def image(fp: Column) -> Column:
    """The 32 popcounts, two bits each."""
    shifted = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(shifted).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(shifted).bitwiseAND(F.lit(LOW))
    return F.shiftleft(two, 1).bitwiseOR(one)


def manhattan(a: Column, b: Column) -> Column:
    """Of two images: counts 0, 1, 2 differ by one where the low bits differ, by two where only the high bits do."""
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups(within: int) -> tuple[list[list[int]], int]:
    """Groups of segments, and the distance (0 or 1) that pairs within `within` keep in one group at least."""
    n = within // 2 + 1
    return [list(map(int, g)) for g in np.array_split(np.arange(32), n)], within // n


def mask(group: list[int]) -> int:
    return long(sum(3 << 2 * s for s in group))


def cells_within(e: Column, group: list[int], reach: int) -> Column:
    """The cell of an image in a group's grid and, for a reach of one, the cells with one segment's count more or less."""
    cell = e.bitwiseAND(F.lit(mask(group)))
    if not reach:
        return F.array(cell)
    bits = lambda n, s: F.lit(long(n << 2 * s))
    low = [F.when(cell.bitwiseAND(bits(2, s)) == 0, cell.bitwiseXOR(bits(1, s))) for s in group]  # 0 to 1, 1 to 0
    high = [F.when(cell.bitwiseAND(bits(3, s)) != 0, cell.bitwiseXOR(bits(3, s))) for s in group]  # 1 to 2, 2 to 1
    return F.array_compact(F.array(cell, *low, *high))


def grid(points: DataFrame, within: int, reach: bool) -> DataFrame:
    """A row (all columns, c, cell) for each group and cell that a point lies in, or reaches."""
    parts, t = groups(within)
    named = lambda c: lambda x: F.struct(F.lit(c).alias("c"), x.alias("cell"))
    each = F.flatten(F.array(*[F.transform(cells_within(image(F.col("fp")), g, t if reach else 0), named(c)) for c, g in enumerate(parts)]))
    return points.select("*", F.explode(each).alias("_g")).select(*points.columns, "_g.c", "_g.cell")


def range_join(a: DataFrame, b: DataFrame, within: int, more: Column | None = None) -> DataFrame:
    """Pairs a, b (a < b) of fingerprints within `within` bits; a: rows with the cells they reach, b: with their own."""
    a, b = a.alias("a"), b.alias("b")
    ea, eb = image(F.col("a.fp")), image(F.col("b.fp"))
    on = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.fp") != F.col("b.fp"))
    if more is not None:
        on &= more
    on &= manhattan(ea, eb) <= within
    on &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= within
    return a.join(b.hint("merge"), on).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()


def stars(points: DataFrame, within: int = 4) -> DataFrame:
    """Pairs a < b of different fingerprints (column fp) within `within` bits: each with the few centres of the cells it reaches."""
    points = points.select("fp")
    place = F.row_number().over(Window.partitionBy("c", "cell").orderBy(F.xxhash64("fp"), "fp"))  # cut down before the shuffle
    centres = grid(points, within, False).withColumn("place", place).where(F.col("place") <= CENTRES).drop("place")
    return stored(range_join(grid(points, within, True), centres, within), "stars")


def links(distinct: DataFrame, within: int = 4) -> DataFrame:
    """Pairs a < b of different fingerprints (column fp) that differ in `within` bits or fewer: as many as hold each component together."""
    points = distinct.select("fp")
    roots = stored(components(stars(points, within)), "roots")
    placed = stored(points.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "placed")
    own, near = grid(placed, within, False), grid(placed, within, True)
    # cells where all rows, and all that reach them, are in one component have nothing to add
    mixed = near.groupBy("c", "cell").agg(F.min("root").alias("low"), F.max("root").alias("top")).where("low < top").select("c", "cell")
    rest = range_join(near.join(mixed.hint("merge"), ["c", "cell"], "left_semi"), own, within, F.col("a.root") < F.col("b.root"))
    return roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(stored(rest, "rest"))


def near_duplicates(documents: DataFrame, words: int = 4, within: int = 4) -> DataFrame:
    """doc_id, fp, component_id, root (the component's smallest fingerprint), h (the text's hash) of each row."""
    docs = stored(fingerprints(documents, words), "fingerprints")
    own = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    nodes = stored(components(links(own, within)).join(own.withColumnRenamed("fp", "node").hint("merge"), "node"), "components")
    least = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    linked = skewed(nodes.select("node", "root"), least, "root", "members", nodes.count()).select(F.col("node").alias("fp"), "root", "component_id")
    every = own.join(linked.hint("merge"), "fp", "left").select("fp", "n", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return skewed(docs, stored(every, "members"), "fp", "n", docs.count()).select("doc_id", "fp", "component_id", "root", "h")
