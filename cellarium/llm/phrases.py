"""Operator 12, collocations by hierarchical pair naming.

Texts are cut into pieces and words, and gathered into blocks of bounded size by language; a block holds its distinct words
once and its text as numbers of these. Words counted often enough over the whole corpus get a global id. In each block two
neighbouring positions whose (k-1)-word phrases have ids make a pair of ids. A block counts its own pairs and deals them to
parts by hash, as sorted and compressed columns; a part joins the pairs of all blocks, counts them, names the frequent ones
and answers each block with the ids of its pairs in their order. Under these the next round pairs again. So a phrase of k
words is named by its two phrases of k-1 words, and these names point to its parents: counts of all first parts follow the
left parents, those of all last parts the right ones, and each phrase tells both parents how frequent it is.

Every word and phrase is dealt once a block, so a word that makes up a third of the corpus is as light as any other; the
number of parts grows with the number of words, so that a part's size does not.
A phrase within a longer one is within a phrase of one word more at least as frequent as that one, which is a candidate too:
asking the next length is asking all.

Edge cases: a null text is empty, a null language is `und`; pieces end with their text; repeated rows count each time; a
text larger than a block is cut between pieces, never within one; a language without candidates has no row, an empty table
none at all; ties in the score go to the higher count, then to the phrase that is first in byte order; further columns are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .shingles import in_small_batches

BLOCK, PART_WORDS = 8 << 20, 2_000_000
#: Blocks that Spark hands to a Python worker at a time: a block's row has megabytes.
RECORDS = 4
#: No byte of UTF-8: stands for the end of a piece.
END = b"\xff"
TO_END = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
BLOCKS = "block long, lang string, words array<string>, counts array<long>, n long, seq binary"
PAIRS = "block long, seq binary, parts array<binary>"
NAMES = "block long, part int, ids binary, lefts binary, rights binary, counts binary"


def pressed(*columns: np.ndarray) -> bytes:
    """Columns of int64, all of one length, compressed together."""
    raw = np.concatenate(columns, dtype="<i8")
    return raw.nbytes.to_bytes(8, "little") + pa.compress(pa.py_buffer(raw), codec="zstd", asbytes=True)


def opened(data: bytes, columns: int = 1) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), "<i8").reshape(columns, -1)


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about `size` bytes, cut between pieces."""
    start = 0
    while len(text) - start > size:
        stop = text.rfind(END, start, start + size)
        stop = text.find(END, start + size) if stop <= start else stop
        if stop < 0:
            break
        yield text[start:stop]
        start = stop
    yield text[start:]


def numbered(parts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and all words as numbers of these with -1 at the ends of pieces."""
    words = pa.chunked_array([pa.array((p + END).replace(END, b" \xff ").split(), pa.binary()) for p in parts]).dictionary_encode().combine_chunks()
    seq, known = words.indices.to_numpy(), words.dictionary
    end = known.index(END).as_py()
    known = pa.concat_arrays([known[:end], known[end + 1 :]])
    seq = np.where(seq == end, -1, seq - (seq > end))
    return known.cast(pa.string()), np.bincount(seq[seq >= 0], minlength=len(known)), seq


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) as rows of BLOCKS, each with a number of its own."""
    held, total, block = defaultdict(list), 0, TaskContext.get().partitionId() << 32
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("seq", pa.binary())])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal block
        for lang, parts in held.items():
            words, counts, seq = numbered(parts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang]), *lists, pa.array([int(counts.sum())], pa.int64()), pa.array([pressed(seq)], pa.binary())], schema=schema)
            block += 1
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in cut(text.as_py().encode().lower().translate(TO_END), size):
                held[lang].append(part)
                total += len(part)
                if total >= size:
                    yield from flush()
                    total = 0
    yield from flush()


def paired(batches: Iterator[pa.RecordBatch], parts: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Rows (block, seq, names) as rows of PAIRS: neighbouring positions that both have an id.

    names: (k, id) of words, or (part, ids) of pairs. Pairs are numbered in the order part, left, right.
    """
    schema = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("parts", pa.list_(pa.binary()))])
    for batch in batches:
        for row in range(batch.num_rows):
            block, seq, names = (c[row] for c in batch.columns)
            (seq,) = opened(seq.as_py())
            if words:
                k, ids = (names.values.field(i).to_numpy() for i in (0, 1))
                table = np.full(max(int(seq.max(initial=-1)), int(k.max(initial=-1))) + 2, -1)  # the last entry is that of position -1
                table[k] = ids
            else:
                got = sorted((x["part"], x["ids"]) for x in names.as_py())
                table = np.concatenate([*(opened(x)[0] for _, x in got), [-1]])
            seq, known = seq.astype(np.int32), table >= 0  # a block's positions and numbers have 32 bits
            known = known[seq]
            at = np.flatnonzero(known[:-1] & known[1:]).astype(np.int32)
            keys = seq[at].astype(np.int64)
            keys *= len(table)
            keys += seq[at + 1]
            order = np.argsort(keys).astype(np.int32)
            keys, at, size = keys[order], at[order], max(len(seq) - 1, 0)
            del seq, known, order
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            first = np.flatnonzero(new)
            keys, counts, number = keys[first], np.diff(first, append=len(new)), np.cumsum(new, dtype=np.int32) - 1
            left, right = table[keys // len(table)], table[keys % len(table)]
            part = part_of(left, right, parts)
            order = np.lexsort((right, left, part))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            following = np.full(size, -1, np.int32)
            following[at] = place[number]
            del at, number, new, first, keys
            starts = np.searchsorted(part[order], np.arange(parts + 1))
            sent = [pressed(np.diff(left[o], prepend=0), right[o], counts[o]) if len(o) else None for o in (order[a:b] for a, b in zip(starts, starts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([pressed(following)], pa.binary()), pa.array([sent], pa.list_(pa.binary()))], schema=schema)


def part_of(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    h = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def merged(rows: pd.DataFrame, min_count: int, answer: bool) -> pd.DataFrame:
    """A part's pairs of all blocks: a row with the frequent ones, and for each block the ids of its pairs, -1 where infrequent."""
    part = int(rows["part"].iloc[0])
    stops = np.cumsum([int.from_bytes(x[:8], "little") // 24 for x in rows["pairs"]])
    left, right, counts = np.empty(stops[-1], np.int64), np.empty(stops[-1], np.int64), np.empty(stops[-1], np.int32)
    for x, stop in zip(rows["pairs"], stops, strict=True):
        steps, other, n = opened(x, 3)
        of = slice(stop - len(n), stop)
        np.cumsum(steps, out=left[of])
        right[of], counts[of] = other, n
    order = np.lexsort((right, left)).astype(np.int32)  # a part has about PART_WORDS rows
    left = left[order]
    right = right[order]
    counts = counts[order]
    new = np.ones(len(order), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts
    often = total >= min_count
    ids, found = np.where(often, (part << 32) + np.cumsum(often) - 1, -1), first[often]
    out = pd.DataFrame({"block": [None], "part": [part], "ids": [pressed(ids[often])], "lefts": [pressed(left[found])], "rights": [pressed(right[found])], "counts": [pressed(total[often])]})
    del left, right, counts, first, found, total, often
    if answer:
        each = np.empty(len(order), np.int64)
        each[order] = ids[np.cumsum(new, dtype=np.int32) - 1]
        del order, new
        out = pd.concat([out, pd.DataFrame({"block": rows["block"].astype("Int64"), "part": part, "ids": [pressed(x) for x in np.split(each, stops[:-1])]})])
    return out.astype({"block": "Int64"})


def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            yield pd.DataFrame(dict(zip(("id", "left", "right", "f"), (opened(x)[0] for x in (row.ids, row.lefts, row.rights, row.counts)), strict=True)))


def named(docs: DataFrame, most_words: int = 3, min_count: int = 10, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words, and words counted by language.

    A phrase has id, lang, words, f, first (counts of its first 1, 2, ... words), last (those of its last ones), and from
    two words on left and right, its parents' ids.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(texts.mapInArrow(partial(blocks, size=block), BLOCKS), "blocks")
    total = rows.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = max(8, -(-(rows.agg(F.sum("n")).first()[0] or 0) // PART_WORDS))
    local = rows.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w")).select("block", "lang", "k", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    one = F.array("f")
    found = local.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count)
    levels = [stored(found.select(F.monotonically_increasing_id().alias("id"), "lang", F.array("word").alias("words"), "f", one.alias("first"), one.alias("last"), "word"), "words")]
    names = local.join(levels[0].select("id", "lang", "word"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("k", "id")).alias("names"))
    for size in range(2, most_words + 1):
        pairs = rows.select("block", "seq").join(names, "block").select("block", "seq", "names").mapInArrow(partial(paired, parts=parts, words=size == 2), PAIRS)
        more = size < most_words
        rows = in_small_batches(pairs, "pairs", RECORDS) if more else pairs
        dealt = rows.select("block", F.posexplode("parts").alias("part", "pairs")).where("pairs is not null")

        def merge(pairs: pd.DataFrame) -> pd.DataFrame:
            return merged(pairs, min_count, more)  # noqa: B023, written within the round

        answers = in_small_batches(dealt.groupBy("part").applyInPandas(merge, NAMES), "names", RECORDS)
        names = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "ids")).alias("names"))
        found = answers.where("block is null").select("ids", "lefts", "rights", "counts").mapInPandas(listed, "id long, left long, right long, f long")
        a = levels[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("head"), "first")
        b = levels[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("tail"), "last")
        words = F.concat("head", F.array("tail")).alias("words")
        levels.append(stored(found.join(a, "left").join(b, "right").select("id", "lang", words, "f", F.concat("first", one).alias("first"), F.concat("last", one).alias("last"), "left", "right"), "phrases"))
    return levels, total


def scored(phrases: DataFrame, size: int) -> DataFrame:
    """The lowest-scoring cut of each phrase of `size` words, ties to the shortest first part; exact in 38 digits."""
    cuts = [F.struct(F.expr(f"cast(1000000 as decimal(38,0)) * a * a div (cast(first[{k - 1}] as decimal(38,0)) * last[{size - k - 1}])").alias("score"), F.lit(k).alias("k"), F.col("first")[k - 1].alias("l"), F.col("last")[size - k - 1].alias("r")) for k in range(1, size)]
    return phrases.withColumn("a", F.col("f").cast("decimal(38,0)")).withColumn("cut", F.array_min(F.array(*cuts)))


def collocations(docs: DataFrame, most_words: int = 3, min_count: int = 10, covered: int = 50, most: int = 2000, block: int = BLOCK) -> DataFrame:
    """Each language's first `most` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase is dropped where a longer candidate that holds it has at least `covered` percent of its count.
    """
    levels, total = named(docs, most_words, min_count, block)
    out = None
    for size in range(2, most_words + 1):
        own = scored(levels[size - 1], size)
        if size < most_words:
            longer = levels[size]
            top = longer.select(F.col("left").alias("id"), "f").union(longer.select("right", "f")).groupBy("id").agg(F.max("f").alias("top"))
            own = own.join(top, "id", "left").where(F.col("top").isNull() | (F.col("top") * 100 < F.col("f") * covered))
        own = own.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        out = own if out is None else out.union(own)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = out.withColumn("rank", place).where(F.col("rank") <= most)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
