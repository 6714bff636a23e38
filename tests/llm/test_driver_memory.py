"""Tables that grow with the corpus are never sent through the driver, however small Spark takes them for."""

import pytest
from pyspark.sql import functions as F

from cellarium.llm import common, components, decontaminate, pii, shingles, simhash


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables stored from here on. No table is taken for bounded, and no key for heavy."""
    seen, real = [], common.stored

    def watched(df, name, **options):
        seen.append(plan(df))
        return real(df, name, **options)

    for module in (simhash, components, shingles, decontaminate, pii):
        monkeypatch.setattr(module, "stored", watched)
    monkeypatch.setattr(common, "HEAVY", 0)
    monkeypatch.setattr(common, "is_small", lambda df: False)
    monkeypatch.setattr(shingles, "is_small", lambda df: False)
    return seen


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    words = [f"{w}{i}" for i in range(20) for w in ("alpha", "beta", "gamma")]
    texts = [" ".join(words), " ".join(words[1:]), " ".join(words[2:]), " ".join(reversed(words)), "other words", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_cells_unrolled_from_fingerprints_are_merged(spark):
    points = spark.range(100).select(F.xxhash64("id").alias("fp"))
    joined = plan(simhash.range_join(simhash.grid(points, 4, True), simhash.grid(points, 4, False), 4))
    assert "SortMergeJoin" in joined and "Broadcast" not in joined


def test_op3_broadcasts_nothing_that_grows(spark, plans):
    found = simhash.near_duplicates(docs(spark))
    assert found.count() == 6 and len(plans) > 8 and not [p for p in [*plans, plan(found)] if "Broadcast" in p]


def test_near_dedup_broadcasts_nothing_that_grows(spark, plans):
    found = shingles.similar(docs(spark))
    roots = {r.doc_id: r.root for r in found.collect()}
    assert roots[0] == roots[1] == roots[2] and len(set(roots.values())) == 4
    assert len(plans) > 12 and not [p for p in [*plans, plan(found)] if "Broadcast" in p]


def test_phrase_candidates_broadcast_nothing_that_grows(spark, plans):
    bench = spark.createDataFrame([(1, "beta3 gamma3 alpha4 beta4")], "item_id long, text string")
    index = decontaminate.Index(docs(spark), bench, 4)
    found = decontaminate.phrase_candidates(index.postings, index.wins, index.counted)
    assert found.count() == 3 and "Broadcast" not in plan(found)


def test_frequent_shingles_are_counted_where_they_are(spark, monkeypatch):
    rows = spark.createDataFrame([(f"a b c d e f w{i} x{i % 3} y",) for i in range(12)] + [(None,)], "text string")
    got = shingles.frequent(rows, 5)
    assert got.dtype.kind == "u" and got.tolist() == sorted(set(shingles.shingles("a b c d e f", 5).tolist()))
