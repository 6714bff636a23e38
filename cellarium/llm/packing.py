"""Operator 5, best-fit packing by bin completion over the histogram of lengths.

Pieces of one length are alike, so the plan needs only how many there are of each length: at most `capacity` numbers,
however many documents. Bin completion fills a sequence around the longest piece left with an undominated set of
others and repeats that filling as often as pieces last; branch-and-bound goes back over the choices (all undominated
fillings, then each repeated less often), prunes by the bound on waste, and starts from the best-fit solution as its
incumbent. It ends at the proven bound, when no choice is left, or after `nodes` fillings looked at, its only limit. Pieces then find their place by their rank among those of their length: ranks come from counts per task and
length, so that no task holds all pieces of a frequent length.

Edge cases: a null or empty text is a piece of the end id alone; equal doc_ids are packed each; an empty table gives
no sequence; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import CACHE_CHUNKS, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
Plan = list[tuple[tuple[int, ...], int]]  # (lengths of a sequence, longest first; how many sequences)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, all pieces of a length at once: sequences with equal contents are one class with a count."""
    open_: dict[int, list[list]] = {}  # room -> classes [contents, count]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                room, contents, n = capacity, (), left
            else:
                contents, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            fit = room // length
            for each, k in ((fit, min(n, left // fit)), (left % fit, 1)):
                k = min(k, n)
                if each and k:
                    open_.setdefault(room - each * length, []).append([contents + (length,) * each, k])
                    left, n = left - each * k, n - k
                if each == fit and (n == 0 or left >= fit):
                    break
            if n and contents:
                open_.setdefault(room, []).append([contents, n])
    return [(tuple(c), n) for classes in open_.values() for c, n in classes]


def fillings(left: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """The undominated sets of available pieces for `room`, least waste first, then longest pieces first; lazily.

    Sums that can be reached are known beforehand, so each step finds a set; None stands for one that is passed over
    because a piece more fits, or because a longer piece left could take the place of one or several of its own.
    """
    lengths = sorted((x for x, n in left.items() if n and x <= room), reverse=True)
    reach, full = [1], (2 << room) - 1  # bit s of reach[j]: lengths[j:] can sum to s
    for x in reversed(lengths):
        r, n, k = reach[-1], min(left[x], room // x), 1
        while n:
            r |= r << min(k, n) * x & full
            n, k = n - min(k, n), 2 * k
        reach.append(r)
    reach.reverse()

    def sums(j: int, rest: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
        while rest and reach[j] >> rest & 1:
            x = lengths[j]
            for n in range(min(left[x], rest // x), 0, -1):
                if reach[j + 1] >> rest - n * x & 1:
                    for others in sums(j + 1, rest - n * x):
                        yield (x,) * n + others
            j += 1

    for waste in range(room + 1):
        if reach[0] >> room - waste & 1:
            for items in sums(0, room - waste):
                used = Counter(items)
                more = sum(1 << x for x in lengths if left[x] > used[x])  # lengths that are left beside the set
                one, several = 0, 0  # sums of one piece, and of two or more
                for x in items:
                    several, one = several | several << x | one << x, one | 1 << x
                longer = several
                for _ in range(waste):
                    longer = longer << 1 | several | one << 1
                yield None if more & (longer | (2 << waste) - 2) else items


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: for each k, pieces over capacity - k stand alone, those over the half each need one of their own, and pieces from k on fill what room these leave."""
    n, w = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for x, c in counts.items():
        n[x + 1], w[x + 1] = c, c * x
    n, w, half, best = np.cumsum(n), np.cumsum(w), capacity // 2, 0
    for k in range(half + 1):
        large, large_w = n[capacity - k + 1] - n[half + 1], w[capacity - k + 1] - w[half + 1]
        rest = (w[half + 1] - w[k]) - (large * capacity - large_w)
        best = max(best, int(n[-1] - n[capacity - k + 1] + large + max(0, -(-rest // capacity))))
    return best


def hopeless(left: dict[int, int], capacity: int, slack: int) -> bool:
    """Whether some piece left can be in no sequence that wastes `slack` or less, whatever the others do."""
    own, reach, full = [x for x, n in left.items() if n], 1, (2 << capacity) - 1  # bit s: pieces left can sum to s
    for x in own:
        n, k = min(left[x], capacity // x), 1
        while n:
            reach |= reach << min(k, n) * x & full
            n, k = n - min(k, n), 2 * k
    return any(not reach >> max(0, capacity - x - slack) & (2 << min(slack, capacity - x)) - 1 for x in own)


def bin_completion(counts: dict[int, int], capacity: int = 1024, nodes: int | None = 20_000) -> Plan:
    """The fewest sequences found for counts[length] pieces of each length, and their contents.

    nodes: how many fillings are looked at; None: until the plan is proven to be one of the fewest.
    """
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    bound = waste_bound(counts, capacity)
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    if used == bound:
        return best
    left = dict(counts)
    path: list[list] = []  # [untried choices, the filling taken, how often, sequences before, weight before]
    bins, weight, spent, nodes = 0, total, 0, float("inf") if nodes is None else nodes

    def take(items: tuple[int, ...], times: int) -> None:
        for x in items:
            left[x] -= times

    def choices() -> Iterator[tuple[tuple[int, ...], int] | None]:
        """Each filling around the longest piece as often as pieces last; then each of them less often."""
        own = {x: n for x, n in left.items() if n}
        top = max(own)
        rest, most = own | {top: own[top] - 1}, 0
        for f in fillings(rest, capacity - top):
            times = f is not None and min(own[x] // n for x, n in Counter((top, *f)).items())
            most = max(most, times)
            yield ((top, *f), times) if times else None
        for less in range(most - 1, 0, -1):
            for f in fillings(rest, capacity - top):
                yield ((top, *f), less) if f is not None and less < min(own[x] // n for x, n in Counter((top, *f)).items()) else None

    while spent < nodes:
        slack = (used - 1 - bins) * capacity - weight  # what a better solution may waste from here on
        if weight and slack >= 0 and not (slack < capacity // 8 and hopeless(left, capacity, slack)):
            path.append([choices(), None, 0, bins, weight])
        elif not weight and bins < used:
            best, used = [(tuple(sorted(p[1], reverse=True)), p[2]) for p in path], bins
            if used == bound:
                break
        choice = None
        while path and choice is None and spent < nodes:  # the next choice, or back to the last one that is left
            spent += 1
            node = path[-1]
            if node[1]:
                take(node[1], -node[2])
                node[1] = None
            if node[3] + -(-node[4] // capacity) >= used:  # a better solution has been found since
                path.pop()
                continue
            try:
                choice = next(node[0])
            except StopIteration:
                path.pop()
        if choice is None:
            break
        node[1], node[2] = choice
        take(*choice)
        bins, weight = node[3] + node[2], node[4] - node[2] * sum(node[1])
    return best


def places(plan: Plan) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted by (length, first rank)."""
    rows, seen, base = [], Counter(), 0
    for items, times in plan:
        at = 0
        for length, n in sorted(Counter(items).items(), reverse=True):
            rows.append((length, seen[length], base, n, at))
            seen[length] += n * times
            at += n * length
        base += times
    rows.sort()
    return dict(zip(("length", "first", "base", "each", "at"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def cut(documents: DataFrame, tokenizer: str, end: int, capacity: int, chunks: int = CACHE_CHUNKS) -> DataFrame:
    """Pieces with their rank among those of the same length in the same task."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, chunks), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                docs, texts = batch.column(0)[at : at + 512], batch.column(1)[at : at + 512].to_pylist()
                ids, sizes = enc.encode_all(texts, end)
                raw, base, out = memoryview(ids).cast("B"), 0, []
                for i, n in enumerate(sizes.tolist()):
                    stop = n % capacity or capacity
                    start = piece = 0
                    while start < n:
                        out.append((i, piece, start, stop - start, zlib.crc32(raw[4 * (base + start) : 4 * (base + stop)]), seen[stop - start]))
                        seen[stop - start] += 1
                        start, stop, piece = stop, stop + capacity, piece + 1
                    base += n
                i, piece, start, length, crc, rank = zip(*out, strict=True) if out else ((),) * 6
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(i, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(out), pa.int64()), pa.array(rank, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


def pack(documents: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, nodes: int | None = 20_000, chunks: int = CACHE_CHUNKS) -> DataFrame:
    pieces = stored(cut(documents, tokenizer, end, capacity, chunks), "pieces")
    here = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in here.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    at = places(bin_completion(counts, capacity, nodes))
    before = here.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # of a group's rows, the join's key holds one task's pieces only; the side `before` has a row for each task and length
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 44
        keys = at["length"] * wide + at["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * wide + rank, "right") - 1
            own, each = rank - at["first"][k], at["each"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at["base"][k] + own // each), pa.array(at["at"][k] + own % each * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, PACKED)
