"""The registered queries' columns, and the digests they derive, on the smallest tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cellarium.llm import queries
from tests.llm.test_models import fingerprint
from tests.llm.test_native import base_spans

SF = "/root/testdata/sf0.001"
DOC, LONG = ("doc_id", "bigint"), "bigint"
COLUMNS = {
    "op1_repair_tokens": [DOC, ("start", LONG), ("n_tokens", LONG), ("ids_crc32", LONG)],
    "op2_url_logistic": [("page_id", LONG), *[(c, "string") for c in ("host", "path", "rule", "verdict")]],
    "op3_simhash_popcount": [DOC, ("fingerprint", "string"), ("component_id", LONG)],
    "op4_additive_quality": [DOC, ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op5_bin_completion": [DOC, ("piece", "int"), *[(c, LONG) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]],
    "op7_brown_score": [DOC, ("held_out", "boolean"), *[(c, LONG) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", "double"), ("score", "double")],
    "op8_additive_quantisation": [("query_id", LONG), ("rank", "int"), ("vec_id", LONG), ("score", "double")],
    "op9_boosted_pii": [DOC, *[(f"n_{k}", LONG) for k in ("email", "ip", "card", "phone")], ("base_sha256", "string"), ("spans", "string")],
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: queries.queries()[name](spark, SF).persist() for name in COLUMNS}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_come_first_and_rows_are_whole(spark, results, name):
    assert results[name].dtypes[: len(COLUMNS[name])] == COLUMNS[name]
    key = COLUMNS[name][0][0]
    if key != "query_id":
        source = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
        assert {r[0] for r in results[name].select(key).collect()} == {r[0] for r in source.select(key).collect()}


def test_fingerprints_are_hexadecimal(spark, results):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in results["op3_simhash_popcount"].collect():
        assert r.fingerprint == f"{fingerprint(text[r.doc_id]):016x}" and r.component_id <= r.doc_id


def test_base_spans_are_digested_in_order(spark, results):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kinds = ["email", "ip", "card", "phone"]
    for r in results["op9_boosted_pii"].collect():
        base = sorted(base_spans(text[r.doc_id]), key=lambda s: (kinds.index(s[0]), s[1]))
        own = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest() and set(own) <= set(r.spans.split(","))
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]


def test_packed_pieces_cover_sequences(results):
    rows = results["op5_bin_completion"]
    whole = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"), F.countDistinct("offset").alias("k"), F.count("*").alias("m"))
    assert whole.where("n <> top or n > 1024 or k <> m").count() == 0
