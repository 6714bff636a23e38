"""Operator 12 against plain counting in Python."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cellarium.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, k long, word string, id long"


def plain(rows, most_words, min_count, covered, most):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, most_words + 1) for i in range(len(w) - m + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    dropped = set()
    for (lang, *w), b in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                g = (lang, *w[i : i + m])
                if 100 * b >= covered * cand[g]:
                    dropped.add(g)
    by_lang = {}
    for (lang, *w), a in cand.items():
        if (lang, *w) not in dropped:
            score, k = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, v in by_lang.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:most], 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = [*"abcdefg", "Ä", "\x00", "\xa0x", "12"]
    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(n))
    out = [(k, text(rng.randint(0, 120)), rng.choice(["en", "en", "de", None, "und"]), 1, "w", 2) for k in range(80)]
    return [*out, (81, None, "en", 0, None, None), (82, "", None, 0, None, None), (None, "hot hot hot hot " * 300, "en", 0, None, None), out[3], out[3], (83, "x", "fr", 0, None, None)]


def test_equals_plain_counting(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for args in ((3, 10, 50, 2000), (3, 4, 80, 7), (5, 3, 50, 50), (2, 10, 50, 2000)):
        assert sorted(map(tuple, phrases.collocations(docs, *args).collect())) == plain(rows, *args), args


def test_query_has_the_columns_of_its_contract(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_pair_naming(spark, str(tmp_path))
    assert found.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert sorted(map(tuple, found.collect())) == plain(rows, 3, 10, 50, 2000)


def test_small_blocks_give_the_same(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, phrases.collocations(docs, 3, 10, 50, 100, block=100).collect())) == plain(rows, 3, 10, 50, 100)


def test_long_texts_are_cut_between_pieces():
    text = phrases.END.join(bytes([97 + k % 26]) * (k % 90) for k in range(200))
    parts = list(phrases.cut(text, 50))
    assert b"".join(parts) == text and len(parts) > 50
    assert all(p.startswith(phrases.END) for p in parts[1:]) and list(phrases.cut(b"a" * 500, 50)) == [b"a" * 500]


def test_counts_beyond_64_bits_stay_exact(spark):
    a, left, right = 3_000_000_000_007, 40_000_000_000_003, 3_000_000_000_009
    got = phrases.scored(spark.createDataFrame([(a, [left, a], [right, a])], "f long, first array<long>, last array<long>"), 2).first()
    assert got.cut.score == 1_000_000 * a * a // (left * right)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def peak(f) -> int:
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_a_part_and_a_block_take_few_bytes_a_row():
    rng, n = np.random.default_rng(3), 400_000
    pairs = [phrases.pressed(np.diff(np.sort(rng.integers(0, 1000, n // 20)), prepend=0), rng.integers(0, 1000, n // 20), np.ones(n // 20, np.int64)) for _ in range(20)]
    rows = pd.DataFrame({"block": np.arange(20), "part": 3, "pairs": pairs})
    assert peak(lambda: phrases.merged(rows, 2, True)) < 70 * n
    seq, names = phrases.pressed(rng.integers(0, 5000, n)), [{"k": k, "id": k} for k in range(5000)]
    batch = pa.record_batch([pa.array([1]), pa.array([seq], pa.binary()), pa.array([names], pa.list_(pa.struct([("k", pa.int32()), ("id", pa.int64())])))], names=["block", "seq", "names"])
    assert peak(lambda: list(phrases.paired(iter([batch]), 8, True))) < 90 * n
