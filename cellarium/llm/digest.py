"""Operator 13, document fingerprints by quartile bucket digests.

A text's UTF-8 bytes are read as triplets, of neighbours and of bytes two and three apart; each triplet's hash counts in
one of BUCKETS buckets. The digest holds, as two hex digits, the length on a logarithmic scale, then two bits a bucket: the
quartile of all buckets' counts that its count lies in. The difference of two digests is the mean distance of quartiles
plus a bounded penalty for lengths; likeness is one less that difference over what two unrelated digests would have (5/4),
and not below zero. Equal texts have equal digests and a likeness of one.

Documents are ordered by one range shuffle of ids and texts. Each task walks its sorted range and keeps one text, the one
before; a range's last row waits for the first row of the next range that has rows. These two rows a range are written with
their texts, the others without, so only what is asked for and two texts a range are kept. The driver holds the numbers of
the ranges with rows.

Edge cases: a null text is an empty one; texts under three bytes have no triplet, and digests that tell lengths only; the
order is by id, falling, rows without an id last, rows of one id by their text's hash; equal rows are each other's
successors; the last row's successor is the first, so that of a single row is itself; an empty table gives no row; further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 512
#: Distances of the second and third byte of a triplet from its first.
TRIPLETS = ((1, 2), (2, 4), (3, 6))
UNRELATED, LENGTH_WEIGHT, LENGTH_MOST = 1.25, 0.15, 4.0
DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
WALKED = DIGEST + ", part int, place int, text string"
WHOLE, FIRST, LAST = 0, 1, 2


def bucket_counts(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """Number of triplets in each bucket; blocks overlap by a triplet's reach, so that memory is bounded for any text."""
    out, reach = np.zeros(BUCKETS, np.int64), max(j for _, j in TRIPLETS)
    for start in range(0, len(text), block):
        a = np.frombuffer(text[start : start + block + reach], np.uint8).astype(np.uint32)
        for salt, (i, j) in enumerate(TRIPLETS):
            n = min(block, len(a) - j)
            if n > 0:
                h = a[:n] * np.uint32(0x9E3779B1) + a[i : i + n] * np.uint32(0x85EBCA77) + a[j : j + n] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
                h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
                out += np.bincount((h ^ h >> np.uint32(13)) % np.uint32(BUCKETS), minlength=BUCKETS)
    return out


def digest(text: bytes) -> str:
    counts = bucket_counts(text)
    cuts = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts[:, None] > cuts).sum(axis=1).reshape(-1, 4)
    size = min(255, round(8 * np.log2(1 + len(text))))
    return bytes([size, *(quartile @ [64, 16, 4, 1]).astype(np.uint8)]).hex()


def likeness(one: str, other: str) -> float:
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (one, other))
    shift = np.array([6, 4, 2, 0], np.uint8)
    p, q = ((x[1:, None] >> shift & 3).astype(int) for x in (a, b))
    lengths = min(abs(int(a[0]) - int(b[0])) / 8, LENGTH_MOST)
    return max(0.0, 1 - (float(np.abs(p - q).mean()) + LENGTH_WEIGHT * lengths) / UNRELATED)


def edited(text: str, following: str) -> str:
    """text with its last third, in code points, replaced by as many of the following text's first, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def finished(doc_id: int | None, text: str, own: str, following: str, theirs: str) -> tuple:
    changed = edited(text, following).encode()
    other = digest(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, theirs)


def to_batch(rows: list[tuple], names: list[str], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), like.types, strict=True)], names=names)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[(c, pa.float64()) for c in ("near_edited", "near_next")], ("part", pa.int32()), ("place", pa.int32()), ("text", pa.string())])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range's rows (doc_id, text), each finished with its successor; the first and last ones with their texts."""
    part, before = TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = digest(text.encode())
            if before is None:
                out.append((doc_id, len(text), None, own, None, None, None, part, FIRST, text))
            else:
                out.append((*finished(*before, text, own), part, WHOLE, None))
            before = doc_id, text, own
        if out:
            yield to_batch(out, ARROW.names, ARROW)
    if before is not None:
        doc_id, text, own = before
        yield to_batch([(doc_id, len(text), None, own, None, None, None, part, LAST, text)], ARROW.names, ARROW)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, own digest, successor's text and digest), finished."""
    like = pa.schema(list(ARROW)[:7])
    for batch in batches:
        rows = [finished(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield to_batch(rows, like.names, like)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's digest, that of its text edited with its successor's, and their likeness. docs: doc_id, text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    walked = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(walk, WALKED), "digests")
    first, last = walked.where(F.col("place") == FIRST), walked.where(F.col("place") == LAST)
    used = sorted(r.part for r in last.select("part").collect())
    following = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, next_part int")
    theirs = first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    pairs = last.join(following, "part").join(theirs, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    own = [c.split()[0] for c in DIGEST.split(", ")]
    return walked.where(F.col("place") == WHOLE).select(*own).unionByName(pairs.mapInArrow(meet, DIGEST))
