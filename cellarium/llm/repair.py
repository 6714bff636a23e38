"""Operator 1, token ids in Re-Pair shards.

Documents are range-partitioned by id, tokenised, and cut into shards of about `shard_tokens` ids. In each shard
frequent pairs of ids are replaced by new symbols, round after round, until none is frequent for the shard's size or
`symbols` numbers are in use. A shard is one row of a Parquet table, written by Spark on any store: rules, their
expansion lengths, the compressed ids, and for each document its first symbol, so that a document, or a span of it, is
decoded without the rest.

Edge cases: a null or empty text has the end id alone; equal doc_ids are ordered by their text's hash, then their text;
null ids come first; an empty table gives no shard; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch
from .tokens import encoder

SHARD = "part long, shard long, n_tokens long, doc_ids array<long>, doc_tokens binary, doc_symbols binary, base long, left binary, right binary, lengths binary, symbols binary, width int"
ROWS = "doc_id long, part long, shard long, local long, n_tokens long, ids_crc32 long"


def compress(ids: np.ndarray, end: int, base: int, min_count: int | None = None, limit: int = 65536) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): symbol base + k stands for left[k], right[k]. No pair with `end` is replaced, so none crosses documents.

    Each round replaces the most frequent pairs, down to an eighth of the highest count; it ends when no pair occurs
    min_count times (None: 4, or one in 20,000 of the shard's ids) or the symbols below `limit` are used up. Of
    overlapping occurrences the first goes.
    """
    min_count = max(4, len(ids) // 20_000) if min_count is None else min_count
    wide = np.uint32 if limit <= 65536 else np.uint64
    shift = wide(16 if limit <= 65536 else 32)
    seq, lefts, rights, n = ids.astype(np.uint32), [], [], base
    while n < limit and len(seq) > 1:
        inner = seq != end
        keys = (seq[:-1].astype(wide) << shift) | seq[1:]
        ordered = np.sort(keys[inner[:-1] & inner[1:]])
        if not len(ordered):
            break
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        pick = np.flatnonzero(counts >= max(min_count, counts.max() // 8))
        if len(pick) > limit - n:
            pick = np.sort(pick[np.argsort(-counts[pick], kind="stable")[: limit - n]])
        if not len(pick):
            break
        chosen = ordered[starts[pick]]
        left, right = (chosen >> shift).astype(np.uint32), (chosen & wide((1 << int(shift)) - 1)).astype(np.uint32)
        is_left, is_right = np.zeros(n, bool), np.zeros(n, bool)
        is_left[left], is_right[right] = True, True
        at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]])
        rule = np.minimum(np.searchsorted(chosen, keys[at]), len(chosen) - 1)
        hit = chosen[rule] == keys[at]
        at, rule = at[hit], rule[hit]
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        first = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
        free = (at - first) % 2 == 0
        at, rule = at[free], rule[free]
        used = np.bincount(rule, minlength=len(chosen)) >= 4
        hit = used[rule]
        at, rule = at[hit], rule[hit]
        if not len(at):
            break
        seq[at] = (n - 1 + np.cumsum(used))[rule]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        lefts.append(left[used])
        rights.append(right[used])
        n += int(used.sum())
    none = np.empty(0, np.uint32)
    return seq, np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def flattened(left: np.ndarray, right: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths): what each symbol expands to; symbols under base stand for themselves."""
    n = len(left)
    seq, owner = np.arange(base, base + n, dtype=np.int64), np.arange(n)
    while len(rest := np.flatnonzero(seq >= base)):
        size = np.ones(len(seq), np.int64)
        size[rest] = 2
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[at] = seq
        out[at[rest]] = left[seq[rest] - base]
        out[at[rest] + 1] = right[seq[rest] - base]
        seq, owner = out, np.repeat(owner, size)
    lengths = np.bincount(owner, minlength=n) if n else np.empty(0, np.int64)
    values = np.concatenate([np.arange(base), seq])
    lengths = np.concatenate([np.ones(base, np.int64), lengths])
    return values.astype(np.uint32), np.cumsum(lengths) - lengths, lengths


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    values, starts, lengths = table
    size = lengths[symbols]
    at = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(starts[symbols] - at, size)]


def to_row(part: int, shard: int, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, end: int, base: int, min_count: int | None = None, limit: int = 65536) -> dict:
    symbols, left, right = compress(ids, end, base, min_count, limit)
    lengths = flattened(left, right, base)[2]
    ends = np.cumsum(lengths[symbols])
    firsts = np.concatenate(([0], np.searchsorted(ends, np.cumsum(sizes)) + 1)).astype("<u4")
    width = 2 if base + len(left) <= 65536 else 4
    raw = lambda a, t: a.astype(t).tobytes()
    return {"part": part, "shard": shard, "n_tokens": len(ids), "doc_ids": doc_ids, "doc_tokens": raw(sizes, "<u4"), "doc_symbols": raw(firsts, "<u4"), "base": base, "left": raw(left, "<u4"), "right": raw(right, "<u4"), "lengths": raw(lengths[base:], "<u4"), "symbols": raw(symbols, f"<u{width}"), "width": width}


class Shard:
    """Random access to one row of the table."""

    def __init__(self, row: dict):
        read = lambda k, t="<u4": np.frombuffer(row[k], t)
        self.symbols, self.firsts, self.sizes = read("symbols", f"<u{row['width']}"), read("doc_symbols"), read("doc_tokens")
        self.left, self.right, self.base = read("left"), read("right"), row["base"]
        self.lengths = np.concatenate([np.ones(self.base, np.int64), read("lengths")])
        self.table = flattened(self.left, self.right, self.base)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.table)

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.firsts[k] : self.firsts[k + 1]], self.table)

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k; only the symbols that cover them are expanded."""
        own = self.symbols[self.firsts[k] : self.firsts[k + 1]]
        ends = np.cumsum(self.lengths[own])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop) + 1
        skip = start - (ends[a - 1] if a else 0)
        return expand(own[a:b], self.table)[skip : skip + stop - start]


def write(documents: DataFrame, path: str, tokenizer: str, end: int = 1, shard_tokens: int = 2_000_000, min_count: int | None = None, symbols: int = 65536) -> None:
    """Shards of about shard_tokens ids; min_count, symbols: what pairs are replaced, see `compress`. Beyond 65,536 symbols take four bytes each."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        base, count = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end + 1), 0
        held: list = []

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            row = to_row(part, count, [d for ids, _, _ in held for d in ids], np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held]), end, base, min_count, symbols)
            held, count = [], count + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist()
                held.append((ids, *enc.encode_all(texts, end)))
                if sum(len(x) for _, x, _ in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.binary()), ("doc_symbols", pa.binary()), ("base", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("width", pa.int32())])
    rows = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows.mapInArrow(shards, SHARD).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, decoded from its shard, with its place among all ids."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                ids, ends = shard.all(), np.cumsum(shard.sizes, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = ends - shard.sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["shard"])), pa.array(starts), pa.array(shard.sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "shard", "local", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARD).parquet(path)
    # ids before a shard: those of earlier partitions, then those of earlier shards of its own; a row for each shard only
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    within = shards.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("inner"))
    place = within.join(before, "part").select("part", "shard", (F.col("first") + F.col("inner")).alias("base"))
    out = shards.mapInArrow(rows, ROWS).join(place, ["part", "shard"])
    return out.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def token_shards(documents: DataFrame, tokenizer: str, end: int = 1, **options: int) -> DataFrame:
    spark = documents.sparkSession
    path = scratch(spark, "repair")
    write(documents, path, tokenizer, end, **options)
    return read(spark, path)
