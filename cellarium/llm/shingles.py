"""Near-duplicates by the Jaccard similarity of word shingles, exact, of SimHash's candidates first.

Sets whose fingerprints agree or meet in operator 3's grid range join of segment popcounts are compared first, each with the
few centres of its cells. Fingerprints of similar sets may differ in more bits than a grid can bound, so prefixes find the
rest, between the components that this gives; shingles whose sets are all in one component have nothing to add.

Two sets of similarity t or more share an element of their prefixes: under any one order of the shingles the first
n - ceil(t n) + 1 of a set of n. Shingles that are frequent in a bounded sample come last in the order, which keeps
common passages out of most prefixes; what the sample holds changes the work, never the result. Sets that share a
prefix shingle are first compared with the few in the middle of them, whose prefixes are shared by most sets and whose
shingles are often in the sample: edits of one text are alike to it more than to each other. What this leaves in different
components is then compared pair by pair, those outside a shingle's largest component with all, so a large group of near
copies costs few pairs. Pairs are ruled out by sizes, by places in the prefixes, by how many elements these share, and by the
parities of the sets' hashes modulo a power of two, of which no more differ than elements do; the sets of the others are
counted. Equal sets are one node throughout.

Edge cases: a null text has no words; texts without words are alike; fewer words than a shingle has: the whole
sequence; repeated rows are returned each; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_small, skewed, stored
from .components import components
from .simhash import BLOCK, bits_set, majority, stars

#: Rows that Spark hands to a Python worker at a time: whole texts and their sets are large, and both sides hold a batch.
RECORDS, RECORDS_CONF = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"
SAMPLE, OFTEN, CENTRES, BITS = 4096, 8, 3, 1024
#: Elements that prefixes of the sets left at last must share; more would take in more of the frequent ones.
SHARED = 3


def in_small_batches(df: DataFrame, name: str, records: int = RECORDS) -> DataFrame:
    """`stored`, with so many rows a batch; the session's setting is as before afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(RECORDS_CONF)
    conf.set(RECORDS_CONF, str(records))
    try:
        return stored(df, name)
    finally:
        conf.set(RECORDS_CONF, before)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The different shingles' XXH64, ascending. A-Z lower-cased, words between white space."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) < words:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    first, last = [0, *(stop[: len(w) - words] + 1).tolist()], stop[words - 1 :].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def late(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which of the set's shingles are in `often` (ascending)."""
    return often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own if len(often) else np.zeros(len(own), bool)


def prefix(own: np.ndarray, often: np.ndarray, share: Fraction) -> np.ndarray:
    """The set's first shingles: those not in `often` (ascending) by value, then the others by value."""
    n = len(own)
    last = late(own, often)
    own = np.concatenate([own[~last], own[last]])
    return own[: n + int(-share * n // 1) + 1] if n else own


def parity(own: np.ndarray) -> bytes:
    """For each remainder of the hashes modulo a power of two, BITS or more and no less than the set's size: is it an odd number's?"""
    size = max(BITS, 1 << len(own).bit_length())
    return np.packbits((np.bincount((own % size).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Elements that only one of two sets has, at least: the differing parities for the smaller power of two."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def fingerprint(own: np.ndarray) -> int:
    """The set's SimHash; of no shingle: zero."""
    return majority(sum((bits_set(own[at : at + BLOCK]) for at in range(0, len(own), BLOCK)), np.zeros(64, np.int64)), len(own))


def by_fingerprints(docs: DataFrame, within: int = 4) -> DataFrame:
    """Pairs a < b of nodes to compare: sets of one fingerprint with the least of them, and the least ones whose fingerprints meet in the grid."""
    nodes = stored(docs.select("fp", "node").distinct(), "fingerprints")
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    same = skewed(nodes, least, "fp", "n", nodes.count()).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    x, y = least.select(F.col("fp").alias("a"), F.col("least").alias("x")), least.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    met = stars(least, within).join(x.hint("merge"), "a").join(y.hint("merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return stored(same.union(met), "alike")


def sampled(documents: DataFrame) -> DataFrame:
    """About SAMPLE rows' different texts, those of small hashes. A bound on the hash picks them where they are read, so no other text is shuffled."""
    n, texts = documents.count(), documents.select("text")
    if n > SAMPLE:
        texts = texts.where(F.xxhash64("text") < F.lit((SAMPLE << 64) // n - (1 << 63)))
    return texts.distinct()


def frequent(documents: DataFrame, words: int) -> np.ndarray:
    """Shingles of OFTEN or more texts of the sample, ascending. They are counted where they are, so no text's set comes to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], names=["s"])

    found = sampled(documents).mapInArrow(rows, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(found.select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64))


def ranked(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """shared (a row for each set's shingle that others have) and middle: by how many sets an element of the prefix is shared, in
    steps of an eighth of a doubling, and the share of the set's shingles that are often in the sample."""
    met = shared.select("s", "node", F.count(F.lit(1)).over(Window.partitionBy("s")).alias("met")).where(F.col("met") > CENTRES)
    found = met.groupBy("node").agg(F.sum("met").alias("met")).join(sets.select("node", "n", "usual").hint("merge"), "node")
    step = F.floor(8 * F.log2(1 + F.col("met") / F.col("n")))
    return shared.join(found.select("node", F.struct(step, F.col("usual") / F.col("n")).alias("middle")).hint("merge"), "node", "left")


def in_several(rows: DataFrame) -> DataFrame:
    """The rows (s, root, ...) of shingles whose sets are in several components, and outside: is it none of the largest of these?"""
    of = Window.partitionBy("s")
    rows = rows.withColumn("low", F.min("root").over(of)).withColumn("top", F.max("root").over(of)).where("low < top").drop("low", "top")
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("s", "root")))
    return rows.withColumn("outside", F.max(F.struct("size", "root")).over(of)["root"] != F.col("root")).drop("size")


def verified(pairs: DataFrame, documents: DataFrame, sets: DataFrame, words: int, share: Fraction) -> DataFrame:
    """The pairs a, b of nodes whose sets (one row a node) have a similarity of share or more. Only texts that are in a pair are read again."""
    p, q = share.numerator, share.denominator

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, words).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["node", "own"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                keep.append(int((both[1:] == both[:-1]).sum()) * (p + q) >= p * len(both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            differ = np.array([differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((n - differ) * (p + q) >= 2 * p * n))

    def members(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return stored(sets.select("node", "h", "n", "parity").join(nodes.hint("merge"), "node", "left_semi"), "members")

    own = members(pairs)
    x, y = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("x")), own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("y"))
    pairs = stored(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(near, "a long, b long"), "near")
    own = members(pairs).select("h", "node")
    texts = documents.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(own) if is_small(own) else own.hint("merge"), "h").select("node", "text").dropDuplicates(["node"])
    whole = in_small_batches(texts.mapInArrow(owned, "node long, own binary"), "sets")
    x, y = whole.select(F.col("node").alias("a"), F.col("own").alias("x")), whole.select(F.col("node").alias("b"), F.col("own").alias("y"))
    return in_small_batches(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "similar")


def similar(documents: DataFrame, words: int = 5, least: str = "0.8") -> DataFrame:
    """doc_id, h (the text's hash) and root (the least node of its component) of each row."""
    share, often = Fraction(least), frequent(documents, words)
    p, q = share.numerator, share.denominator

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [shingles(t, words) for t in part.column(1).to_pylist()]
                node = np.array([xxh64_intdigest(s.tobytes(), 0) for s in own], np.uint64).view(np.int64)
                fp = np.array([fingerprint(s) for s in own], np.uint64).view(np.int64)
                first = [prefix(s, often, share).view(np.int64) for s in own]
                usual = [int(late(s, often).sum()) for s in own]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node), pa.array(fp), pa.array([len(s) for s in own], pa.int32()), pa.array(usual, pa.int32()), pa.array([parity(s) for s in own], pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "h", "node", "fp", "n", "usual", "parity", "first"])

    docs = in_small_batches(documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(rows, "doc_id long, h long, node long, fp long, n int, usual int, parity binary, first array<long>"), "shingles")
    sets = stored(docs.select("node", "h", "fp", "n", "usual", "parity").dropDuplicates(["node"]), "nodes")  # copies are put together before the shuffle
    links = verified(by_fingerprints(docs), documents, sets, words, share)
    roots = stored(components(links), "roots")
    keyed = docs.select("node", "n", "first").join(F.broadcast(roots) if is_small(roots) else roots.hint("merge"), "node", "left")
    keyed = keyed.select("node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("first").alias("pos", "s"))
    of = Window.partitionBy("s")  # equal sets are one node, and have equal prefixes
    shared = keyed.select("s", "node", "n", "pos", "root", F.min("root").over(of).alias("low"), F.max("root").over(of).alias("top"))
    shared = stored(shared.where("low < top").select("s", "node", "n", "pos", "root").distinct(), "shared")

    def sized(n, m):
        return F.least(n, m) * q >= F.greatest(n, m) * p

    def follows(n, m, i, j):
        """Of sets whose first common element is at these places of their orders: can what follows make them similar?"""
        return F.least(n - i, m - j) * (p + q) >= (n + m) * p

    def pairs(a: DataFrame, b: DataFrame, on) -> DataFrame:
        n, m, i, j = (F.col(c) for c in ("a.n", "b.n", "a.pos", "b.pos"))
        found = a.alias("a").join(b.alias("b").hint("merge"), (F.col("a.s") == F.col("b.s")) & on & sized(n, m) & follows(n, m, i, j))
        return found.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()

    def sharing(a: DataFrame, b: DataFrame, on) -> DataFrame:
        """Pairs with SHARED or more common elements among the first n - o + SHARED of their orders, for an overlap of o or more.

        Of the set for which these elements end first, those that the other set has are among the other's; no more than n - o miss.
        The prefixes' lengths bound SHARED: where one has fewer elements than that, as many less are asked for.
        """
        n, m, i, j = (F.col(c) for c in ("a.n", "b.n", "a.pos", "b.pos"))
        over = F.ceil((n + m) * p / (p + q))
        most = F.least(F.lit(SHARED), over + 1 - F.ceil(F.greatest(n, m) * p / q))
        first = (i < n - over + most) & (j < m - over + most)
        found = a.alias("a").join(b.alias("b").hint("merge"), (F.col("a.s") == F.col("b.s")) & on & sized(n, m) & first)
        found = found.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"), most.alias("most"))
        return found.groupBy("a", "b", "most").agg(F.count(F.lit(1)).alias("c")).where("c >= most").select("a", "b")

    apart = F.col("a.root") != F.col("b.root")
    place = F.row_number().over(of.orderBy(F.desc("middle"), F.xxhash64("node"), "node"))  # one order for all shingles: a group's shingles choose the same sets
    centres = ranked(shared, sets).withColumn("place", place).where(F.col("place") <= CENTRES).drop("place", "middle")
    links = links.union(verified(stored(pairs(centres, shared, apart), "stars"), documents, sets, words, share))
    placed = shared.drop("root").join(components(links).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(in_several(placed), "placed")
    once = ~F.col("b.outside") | (F.col("a.node") < F.col("b.node"))
    rest = stored(sharing(placed.where("outside"), placed, once & apart), "rest")
    links = links.union(verified(rest, documents, sets, words, share))
    roots = stored(components(links), "roots")
    return docs.select("doc_id", "h", "node").join(F.broadcast(roots) if is_small(roots) else roots.hint("merge"), "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))
