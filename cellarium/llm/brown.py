"""Operator 7, language-model scores from a class-based bigram model over the whole vocabulary.

Words of the training texts are counted over all tasks. The `clustered` most frequent words are put into classes by
exchange: each word in turn moves to the class that raises the likelihood of the class bigrams most. Every other word
of training, however rare, is then assigned in a distributed pass to the class whose bigrams with the classes of its
neighbours, counted over all its occurrences, gain most by the same objective. Transitions are counted between the
classes of all words, on both sides.

The probability of a text is that of its words' classes, each after the class before, times that of each word in its
class: c(w) over the class's count. Words not seen are a class of their own, which has the transitions of the words seen
once, counted a second time; such a word is one of as many as there are words seen once, and one more. Transitions are
backed off to the classes' shares. So the probabilities of all words, of the end and of the unseen words sum to one
after any history.

Words above a count that at most `common` words pass, and of at most LONGEST bytes, are looked up where the text is,
from a table of bounded size; the rest, however many, meet their classes and counts by a join. The class bigrams of the
clustered words and the transitions are all that comes to the driver beside them.

Edge cases: a null text is empty and is its end alone; without training texts all words are unseen; repeated rows are
scored each; a null doc_id is no held-out one; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, stored

CLUSTERED, CLASSES, COMMON, FLUSH, LONGEST = 1024, 64, 120_000, 400_000, 64
ONCE = 1 << 12  # added to the class of a word seen once, in a sequence of classes


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def counted(training: DataFrame) -> DataFrame:
    """word, c over all training texts, stored."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for t in batch.column(0):
                seen.update(words(t.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return stored(training.select("text").mapInArrow(partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


def bigrams(training: DataFrame, place: dict[bytes, int], k: int) -> np.ndarray:
    """Counts of neighbouring words: the k clustered ones, k for all others, k + 1 for the end. At most (k + 2)² rows come to the driver."""
    size = k + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held = np.empty(0, np.int64), np.empty(0, np.int64), []

        def merge() -> None:
            nonlocal keys, n, held
            found, inverse = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n, np.ones(len(inverse) - len(n), np.int64)]), len(found)).astype(np.int64)
            keys, held = found, []

        get = place.get
        for batch in batches:
            for t in batch.column(0):
                ids = np.array([k + 1, *[get(w, k) for w in words(t.as_py())], k + 1], np.int64)
                held.append(ids[:-1] * size + ids[1:])
                if len(held) >= 512:
                    merge()
        if held:
            merge()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    rows = training.select("text").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out.reshape(size, size)


def exchange(counts: np.ndarray, classes: int, passes: int = 12) -> np.ndarray:
    """The class of each word; the last two rows of counts (other words, the end) stay in classes of their own.

    The objective is that of the class bigram model: the sum of f(count of a class pair), less that of f(class count)
    as left and as right one, with f(x) = x log x. Words move in order until a pass moves none.
    """
    k = len(counts) - 2
    classes = max(1, min(classes, k))
    own = np.concatenate([np.arange(k) % classes, [classes, classes + 1]])
    m, each = classes + 2, np.arange(classes)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    member = np.zeros((k + 2, m))
    member[np.arange(k + 2), own] = 1
    pair, right, left = member.T @ counts @ member, counts @ member, counts.T @ member
    for _ in range(passes):
        moved = 0
        for w in range(k):
            a, loop = own[w], counts[w, w]
            out, into = right[w].copy(), left[w].copy()  # of the word with each class, to its right and to its left
            out[a] -= loop
            into[a] -= loop
            pair[a] -= out
            pair[:, a] -= into
            pair[a, a] -= loop
            rows, cols = pair.sum(1), pair.sum(0)
            # in class c only row and column c change; their common entry counts once
            fp, r, s = f(pair), f(pair[:classes] + out), f(pair[:, :classes].T + into)
            both = f(pair[each, each] + out[each] + into[each] + loop)
            gain = r.sum(1) - r[each, each] + s.sum(1) - s[each, each] + both
            gain -= fp[:classes].sum(1) + fp[:, :classes].sum(0) - fp[each, each]
            gain -= f(rows + out.sum() + loop)[:classes] - f(rows)[:classes] + f(cols + into.sum() + loop)[:classes] - f(cols)[:classes]
            b = int(np.argmax(gain))
            b = b if gain[b] > gain[a] + 1e-9 else a
            pair[b] += out
            pair[:, b] += into
            pair[b, b] += loop
            if b != a:
                own[w] = b
                moved += 1
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if not moved:
            break
    return own


def context_gains(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What each class gains, to first order in the exchange's objective, by an occurrence between a left and a right class.

    Row left * m + right; a column for each class of clustered words.
    """
    m = int(own.max()) + 1
    member = np.zeros((len(own), m))
    member[np.arange(len(own)), own] = 1
    pair = member.T @ counts @ member
    before = np.log(pair + 0.5) - np.log(pair.sum(0) + 0.5)  # [left, class]
    after = (np.log(pair + 0.5) - np.log(pair.sum(1, keepdims=True) + 0.5)).T  # [right, class]
    return (before[:, None, : m - 2] + after[None, :, : m - 2]).reshape(m * m, m - 2)


def assigned(training: DataFrame, place: dict[bytes, int], gains: np.ndarray) -> DataFrame:
    """word, c, kind of every training word that is not clustered, stored. A word's contexts are at most the pairs of classes."""
    k = gains.shape[1]
    m = k + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[bytes, list[int]] = defaultdict(list)
        held, get = 0, place.get

        def out() -> pa.RecordBatch:
            pairs, times, sizes = [], [], []
            for own in seen.values():
                if len(own) > 64:
                    own, n = (x.tolist() for x in np.unique(own, return_counts=True))
                    times += n
                else:
                    times += [1] * len(own)
                pairs += own
                sizes.append(len(own))
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((pairs, pa.int32()), (times, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), *lists], names=["word", "contexts", "times"])

        for batch in batches:
            for t in batch.column(0):
                w = words(t.as_py())
                kinds = np.array([k + 1, *[get(x, k) for x in w], k + 1], np.int64)
                at = np.flatnonzero(kinds[1:-1] == k).tolist()
                for i, pair in zip(at, (kinds[:-2] * m + kinds[2:])[at].tolist(), strict=True):
                    seen[w[i]].append(pair)
                held += len(at)
                if held > 4 * FLUSH:
                    yield out()
                    seen.clear()
                    held = 0
        if seen:
            yield out()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their words; a word's sum is carried on from part to part, so memory is bounded."""
        word, total, n = None, np.zeros(k), 0
        out = lambda w, c, t: pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(c, pa.int64()), pa.array(np.round(t, 9).argmax(1).astype(np.int32))], names=["word", "c", "kind"])
        for batch in batches:
            stops = np.cumsum(batch.column(1).value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:  # parts of some 32,768 contexts
                to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + 32768)))
                part = batch.slice(at, to - at)
                own, first = part.column(0), stops[at - 1] if at else 0
                new = np.concatenate(([True], pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)))
                starts = np.concatenate(([0], stops[at : to - 1] - first))[new]
                pairs, times = (part.column(i).flatten().to_numpy() for i in (1, 2))
                score, sums = np.add.reduceat(gains[pairs] * times[:, None], starts, axis=0), np.add.reduceat(times, starts)
                heads = own.filter(pa.array(new)).to_pylist()
                if word == heads[0]:
                    score[0] += total
                    sums[0] += n
                elif word is not None:
                    yield out([word], [n], total[None])
                word, total, n = heads[-1], score[-1], sums[-1]
                if len(heads) > 1:
                    yield out(heads[:-1], sums[:-1], score[:-1])
                at = to
        if word is not None:
            yield out([word], [n], total[None])

    rows = training.select("text").mapInArrow(partial, "word binary, contexts array<int>, times array<long>").repartition("word").sortWithinPartitions("word")
    return stored(rows.mapInArrow(best, "word binary, c long, kind int"), "classes")


@dataclass
class Vocabulary:
    """clustered: word -> (count, class) of the clustered words; rest: word, c, kind of all other training words; k classes."""

    clustered: dict[bytes, tuple[int, int]]
    rest: DataFrame
    k: int
    ends: int
    tokens: int
    distinct: int
    once: int


def learn(training: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES) -> Vocabulary:
    counts = counted(training)
    ends = training.count()
    total, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    top = [(bytes(w), c) for w, c in counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(clustered).collect()]
    table = bigrams(training, {w: i for i, (w, _) in enumerate(top)}, len(top))
    if top:
        own = exchange(table, classes)
        gains = context_gains(table, own)
    else:
        own, gains = np.array([1, 2]), np.zeros((9, 1))  # words that are longer than LONGEST alone, or none: one class
    kept = {w: (c, int(own[i])) for i, (w, c) in enumerate(top)}
    return Vocabulary(kept, assigned(training, {w: x for w, (_, x) in kept.items()}, gains), gains.shape[1], ends, total + ends, distinct + (ends > 0), once)


def sequences(docs: DataFrame, vocabulary: Vocabulary, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base (the sum of log10(c + 0.5)), emit (that of log10(c) of known words) and kinds, the classes in order, stored."""
    v, k = vocabulary, vocabulary.k
    rest = v.rest.where(F.octet_length("word") <= LONGEST)
    # the least count that at most `common` words have: from the number of words of each count, a short list
    cut, passed = 0, 0
    for r in rest.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(common + 1).collect():
        if passed + r["n"] > common:
            cut = r["c"]
            break
        passed += r["n"]
    known = [(w, *x) for w, x in v.clustered.items()] + [(bytes(w), c, x) for w, c, x in rest.where(F.col("c") > cut).collect()]
    place = {w: i for i, (w, _, _) in enumerate(known)}
    c = np.array([0, *[x[1] for x in known]], float)[1:]
    near, emit = np.log10(c + 0.5), np.log10(np.maximum(c, 1))
    kind = np.array([0, *[x[2] + ONCE * (x[1] == 1) for x in known]], np.int16)[1:]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, get = TaskContext.get().partitionId(), 0, place.get
        names = ["row", "doc_id", "held_out", "n_known", "base", "emit", "kinds", "rare", "which"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, text, held in zip(*(batch.column(i)[at : at + 256].to_pylist() for i in range(3)), strict=True):
                    w = words(text)
                    ids = np.array([get(x, -1) for x in w], np.int64)
                    low = ids >= 0
                    kinds = np.full(len(w), -1, np.int16)
                    kinds[low] = kind[ids[low]]
                    rare: dict[bytes, int] = {}
                    which = np.array([rare.setdefault(w[i], len(rare)) for i in np.flatnonzero(~low).tolist()], np.int32)
                    out.append(((part << 33) + seen, doc_id, held, int(low.sum()), near[ids[low]].sum(), emit[ids[low]].sum(), kinds.tobytes(), list(rare), which.tobytes()))
                    seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    fields = "doc_id long, held_out boolean, n_known long, base double, emit double, kinds binary"
    rows = stored(docs.select("doc_id", "text", "held_out").mapInArrow(partial, f"row long, {fields}, rare array<binary>, which binary"), "words")
    uses = rows.select("row", F.posexplode("rare").alias("i", "word")).join(v.rest, "word")
    found = uses.groupBy("row").agg(F.collect_list(F.struct("i", "c", "kind")).alias("found"))  # a text's own words only

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, stops = batch.column(6).to_numpy(), np.cumsum(np.nan_to_num(pc.list_value_length(batch.column(8)).to_numpy(zero_copy_only=False)).astype(np.int64))
            own = batch.column(8).flatten()
            index, count, cls = (own.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            cls = cls + ONCE * (count == 1)
            n_known, near, emitted, kinds = np.empty(len(size), np.int64), np.empty(len(size)), np.empty(len(size)), []
            for i, (raw, which) in enumerate(zip(batch.column(5).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                here = slice(stops[i - 1] if i else 0, stops[i])
                c, x = np.zeros(size[i]), np.full(size[i], k + 1, np.int16)
                c[index[here]], x[index[here]] = count[here], cls[here]
                which, seq = np.frombuffer(which, np.int32), np.frombuffer(raw, np.int16).copy()
                c = c[which]
                seq[seq == -1] = x[which]
                n_known[i], near[i], emitted[i] = (c > 0).sum(), np.log10(c + 0.5).sum(), np.log10(np.maximum(c, 1)).sum()
                kinds.append(seq.tobytes())
            sums = [pa.array(batch.column(j).to_numpy() + y) for j, y in ((2, n_known), (3, near), (4, emitted))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums, pa.array(kinds, pa.binary())], names=["doc_id", "held_out", "n_known", "base", "emit", "kinds"])

    whole = rows.select("row", "doc_id", "held_out", "n_known", "base", "emit", "kinds", F.size("rare").alias("size"), "which")
    whole = whole.join(found.hint("merge"), "row", "left").select("doc_id", "held_out", "n_known", "base", "emit", "kinds", "size", "which", "found")
    return stored(whole.mapInArrow(complete, fields), "sequences")


def transitions(rows: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each: k classes, the end (k), unseen words (k + 1), for which words seen once count again."""
    m = k + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                kinds = np.concatenate(([k], np.frombuffer(raw.as_buffer(), np.int16).astype(np.int64), [k]))
                once, kinds = kinds >= ONCE, kinds % ONCE
                a, b, u, x = kinds[:-1], kinds[1:], once[:-1], once[1:]
                total += np.bincount(np.concatenate([a * m + b, a[x] * m + k + 1, (k + 1) * m + b[u], np.full(int((u & x).sum()), m * m - 1)]), minlength=m * m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    found = rows.select("kinds").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(m * m)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return out.reshape(m, m)


def probabilities(counts: np.ndarray, once: int, mu: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of class after class, log10 of what a word's count is divided by in each class; one for the end)."""
    m = len(counts)
    share = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * m)
    step = (counts + mu * share) / (counts.sum(1, keepdims=True) + mu)
    size = counts[: m - 1].sum(0)  # without the history of unseen words, whose tokens are counted elsewhere
    return np.log10(step), np.log10(np.concatenate([np.maximum(size[: m - 2], 1), [1.0, once + 1.0]]))


def score(documents: DataFrame, folds: int = 5, fold: int = 1, clustered: int = CLUSTERED, classes: int = CLASSES, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row; held-out rows teach nothing."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False)))
    v = learn(docs.where(~F.col("held_out")), clustered, classes)
    rows, k = sequences(docs, v, common), v.k
    step, size = probabilities(transitions(rows.where(~F.col("held_out")), k), v.once)
    flat, m, base, end = step.ravel(), k + 2, log10(v.tokens + 0.5 * (v.distinct + 1)), log10(v.ends + 0.5)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows)
            for i, raw in enumerate(batch.column(5)):
                kinds = np.frombuffer(raw.as_buffer(), np.int16).astype(np.int64) % ONCE
                path = np.concatenate(([k], kinds, [k]))
                n[i], total[i] = len(kinds) + 1, flat[path[:-1] * m + path[1:]].sum() - size[kinds].sum()
            total += batch.column(4).to_numpy()
            near = batch.column(3).to_numpy() + end - n * base
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(batch.column(2).to_numpy() + (v_ends > 0)), pa.array(near), pa.array(total), pa.array(10 ** (-total / n))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    v_ends = v.ends
    out = rows.select("doc_id", "held_out", "n_known", "base", "emit", "kinds").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, perplexity double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
