"""Operator 4, quality classifier: a generalised additive model with pairwise interactions.

Each whole text gives a row of language-free features. Features are cut into bins at quantiles of the training rows;
cyclic boosting fits a shallow tree to one feature's histogram of gradients at a time and adds it to that feature's
lookup table, then does the same for the pairs of features that promise most. A score is the sum of the tables' entries
at a text's bins, through the logistic function.

Training takes labelled rows outside the held-out fold, at most `sample` of them, those with the smallest hash of their
id; labels, lang, source and ids are no inputs. Their ids alone are broadcast, at most `sample`; texts are never shuffled,
and one pass makes the features and scores of all rows.

Edge cases: a null text is empty and gets a score; a null label is no label; with one kind of label only the score is
near that label's share; repeated rows are scored each; a null doc_id counts as held out only if its remainder says so
(null: not held out); an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

FEATURES = ("words", "word_length", "long_words", "upper", "symbols", "digits", "distinct", "top_word", "adjacent", "distinct_lines", "line_length", "short_words", "stops", "marked_words", "odd_bytes", "symbol_runs")
BINS, PAIR_BINS, SAMPLE = 32, 8, 12_000

_kind = np.zeros((256, 5))
_kind[65:91, 0] = 1  # upper case
_kind[97:123, 1] = 1  # lower case
_kind[48:58, 2] = 1
_kind[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"], 3] = 1
_kind[[ord(c) for c in ".!?"], 4] = 1


def features(text: str | None) -> list[float]:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    words = (text or "").split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    upper, lower, digits, symbols, stops = np.bincount(raw, minlength=256) @ _kind
    high = int((raw > 127).sum())
    length = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    odd = ~np.isin(raw, _WORDLIKE)
    runs = int((odd[1:] & odd[:-1]).sum())
    marked = sum(not w[-1].isalnum() for w in words)
    return [
        float(np.log1p(n)), float(length.mean()), float((length > 12).mean()), upper / max(1, upper + lower), symbols / size, digits / size,
        len(counts) / n**0.85, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), float(np.log1p(size / len(lines))),
        float((length <= 3).mean()), stops / n, marked / n, high / size, runs / size,
    ]


_WORDLIKE = np.array([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 32, 10], np.uint8)


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float32).reshape(-1, len(FEATURES))


def _step(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, cut) of the best split of a histogram: bins under the cut, and the others."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float = 2.0, depth: int = 2) -> np.ndarray:
    """A tree of that depth over ordered bins, as the value for each bin."""
    if depth and len(g) > 1:
        gain, cut = _step(g, h, ridge)
        if gain > 1e-6:
            return np.concatenate([_tree(g[:cut], h[:cut], ridge, depth - 1), _tree(g[cut:], h[cut:], ridge, depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + ridge))


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[float, np.ndarray]:
    """Over two features: a cut on one, then one on the other within each part."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (0, 1):
        a, b = (g, h) if turn == 0 else (g.T, h.T)
        top, cut = _step(a.sum(1), b.sum(1), ridge)
        value, gain = np.empty_like(a), top
        for part in (slice(0, cut), slice(cut, None)):
            inner, at = _step(a[part].sum(0), b[part].sum(0), ridge)
            gain += inner
            for side in (slice(0, at), slice(at, None)):
                value[part, side] = -a[part, side].sum() / (b[part, side].sum() + ridge)
        if gain > best:
            best, out = gain, value if turn == 0 else value.T
    return best, out


class Additive:
    """edges: of each feature's bins; tables: log odds by bin; pairs: (i, j, table over coarse bins)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, pairs: int = 8, rate: float = 0.15):
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(f)]
        share = (y.sum() + 0.9) / (n + 1)
        self.base, self.tables, self.pairs = float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in self.edges], []
        self.coarse = [np.linspace(0, PAIR_BINS, len(e) + 1, endpoint=False).astype(int) for e in self.edges]
        if not 0 < y.sum() < n:
            return
        bins, score = self.bins(x), np.full(n, self.base)
        fold = np.arange(n) % 5 == 0  # rows to stop by
        fit = ~fold

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return (p - y) * fit, np.maximum(p * (1 - p), 1e-6) * fit

        def loss() -> float:
            return float(np.logaddexp(0, np.where(y[fold] > 0, -score[fold], score[fold])).mean())

        def boost(tables: list[np.ndarray], index: list[np.ndarray], grow) -> None:
            nonlocal score
            best, kept, stale = loss(), [t.copy() for t in tables], 0
            for _ in range(rounds):
                for t, b in zip(tables, index, strict=True):
                    g, h = slopes()
                    step = rate * grow(np.bincount(b, g, t.size).reshape(t.shape), np.bincount(b, h, t.size).reshape(t.shape))
                    t += step
                    score = score + step.ravel()[b]
                now = loss()
                if now < best - 1e-6:
                    best, kept, stale = now, [t.copy() for t in tables], 0
                elif (stale := stale + 1) >= 12:
                    break
            for t, k, b in zip(tables, kept, index, strict=True):
                score = score + (k - t).ravel()[b]
                t[...] = k

        boost(self.tables, [bins[:, j] for j in range(f)], _tree)
        g, h = slopes()
        found = []
        for i in range(f):
            for j in range(i + 1, f):
                b = self.coarse[i][bins[:, i]] * PAIR_BINS + self.coarse[j][bins[:, j]]
                gain, _ = _tree2(np.bincount(b, g, PAIR_BINS**2).reshape(PAIR_BINS, -1), np.bincount(b, h, PAIR_BINS**2).reshape(PAIR_BINS, -1))
                found.append((-gain, i, j, b))
        found = sorted(found, key=lambda r: r[:3])[:pairs]
        tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in found]
        boost(tables, [r[3] for r in found], lambda a, b: _tree2(a, b)[1])
        self.pairs = [(i, j, t) for (_, i, j, _), t in zip(found, tables, strict=True)]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[bins[:, j]]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 4, fold: int = 2) -> Additive:
    """The model of at most `sample` labelled rows outside the fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).distinct()
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    first = marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, matrix(part.column(2).to_pylist()).T)], names=["doc_id", "y", *FEATURES])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(first), "doc_id").select("doc_id", "y", "text")
    found = found.mapInArrow(rows, "doc_id long, y int, " + ", ".join(f"{f} float" for f in FEATURES))
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", *FEATURES).limit(sample).toArrow()
    return Additive(np.stack([table[f].to_numpy() for f in FEATURES], axis=1), table["y"].to_numpy().astype(float))


def kept(documents: DataFrame, model: Additive, threshold: float = 0.7) -> DataFrame:
    """The rows of documents, with all their columns, whose score reaches the threshold."""
    text = documents.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(matrix(batch.column(text).to_pylist())) >= threshold, pa.bool_()))

    return documents.mapInArrow(passed, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, h (the text's hash) of each row of documents; held out: crc32 of the id leaves `fold` modulo `folds`."""
    model = learn(documents, labels, sample, folds, fold)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = model.score(matrix(part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), part.column(2)], names=["doc_id", "held_out", "score", "predicted", "h"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), folds, fold).alias("held_out"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, h long")
