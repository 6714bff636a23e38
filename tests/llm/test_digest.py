"""Operator 13 against a plain walk over the sorted documents."""

import hashlib
import random

import numpy as np

from cellarium.llm import digest, queries

SCHEMA = "doc_id long, text string, part int, place string"


def plain_counts(b):
    out = np.zeros(digest.BUCKETS, int)
    for salt, (i, j) in enumerate(digest.TRIPLETS):
        for k in range(len(b) - j):
            h = (b[k] * 0x9E3779B1 + b[k + i] * 0x85EBCA77 + b[k + j] * 0xC2B2AE3D + salt * 0x27D4EB2F) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            out[(h ^ h >> 13) % digest.BUCKETS] += 1
    return out


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnoprstuvwä", k=rng.randint(2, 9))) for _ in range(n))


def test_counts_in_blocks_equal_single_triplets():
    b = random.Random(2).randbytes(1000)
    for block in (7, 64, 4096):
        assert (digest.bucket_counts(b, block) == plain_counts(b)).all()


def test_likeness_is_bounded_and_orders_edits():
    rng = random.Random(4)
    one, other = text(rng, 400), text(rng, 400)
    d = [digest.digest(t.encode()) for t in (one, one[:-200] + other[:200], digest.edited(one, other), other, "", "ab")]
    near = [digest.likeness(d[0], x) for x in d]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] + 0.2 and all(0 <= v <= 1 for v in near)
    assert digest.likeness(d[1], d[2]) == digest.likeness(d[2], d[1])


def check(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_quartile_digest(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("n_chars", "bigint"), *[(c, "string") for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", "double"), ("near_next", "double")]
    given = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for k, (i, t) in enumerate(given):
        n = given[(k + 1) % len(given)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a, b, c = (digest.digest(x.encode()) for x in (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, digest.likeness(a, b), digest.likeness(a, c)))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_equals_a_plain_walk(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k * 3, text(rng, rng.choice([0, 1, 2, 30, 200])), 1, "x") for k in range(60)]
    rows += [(1, None, 0, None), (2, "", 0, None), (4, "ab", 0, None), (5, "é\U0001f600" * 50, 0, None), (7, text(rng, 40_000), 0, None), (-8, "same", 0, None), (None, "no id", 0, None)]
    check(spark, rows, tmp_path)


def test_repeated_rows_follow_each_other(spark, tmp_path):
    spark.createDataFrame([(5, "some words that repeat", 0, "")] * 40, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op13_quartile_digest(spark, str(tmp_path)).collect()}
    (row,) = got
    text = digest.edited("some words that repeat", "some words that repeat")
    assert row[2] == hashlib.sha256(text.encode()).hexdigest() and row[6] == 1.0


def test_single_row_and_empty_table(spark, tmp_path):
    check(spark, [(3, "only one document", 0, "")], tmp_path)
    assert digest.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_edits_are_nearer_than_strangers(spark):
    """Held against all documents of the small table whose successor is neither a copy nor a near copy."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [r for r in digest.fingerprints(docs).collect() if r.n_chars >= 200]
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.93
