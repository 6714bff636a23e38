"""From raw documents to packed sequences: quality, near-duplicates, benchmark contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. What a stage drops or changes is
keyed by (doc_id, hash of the text), so rows without an id or with a repeated one are told apart by their text.

Edge cases: a null text is judged as an empty one; a null doc_id is an id like others; of rows equal in id and text one
stays after the near-duplicate stage; further columns are carried along whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import scratch, skewed, stored, table
from cellarium.llm.decontaminate import Index, hits
from cellarium.llm.packing import pack
from cellarium.llm.pii import redacted, span_lists
from cellarium.llm.quality import kept, learn
from cellarium.llm.shingles import similar
from cellarium.llm.tokens import public_path

NO_ID = -(1 << 63)
#: Chunks that a worker's tokenizer remembers, times two: the stages share the workers, which keep them to the end.
CHUNKS = 100_000


def id_of(c: str = "doc_id"):
    return F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias("d")


def wrapped(docs: DataFrame) -> DataFrame:
    """row (all columns), d, h: nothing of docs can clash with a key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_of(), F.xxhash64("text").alias("h"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are scored and dropped where they are read."""
    return kept(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups link rows whose 5-word shingles have a Jaccard similarity of 0.8 or more, op3's candidates compared first.

    Of each the row with the smallest id stays; a row without an id only where no other one has an id. What is dropped
    grows with the corpus and meets the texts by a shuffle at every size.
    """
    rows = stored(similar(docs).select(id_of(), "h", "root", F.struct(F.col("doc_id").isNull().alias("none"), id_of(), "h").alias("rank")), "near")
    first = rows.groupBy("root").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = skewed(rows, stored(first, "first"), "root", "n", rows.count())
    dropped = ranked.where("rank > first").select("d", "h").distinct()
    left = wrapped(docs).join(dropped.hint("merge"), ["d", "h"], "left_anti")
    if ranked.where("rank = first").groupBy("root").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["d", "h"])  # rows that are equal in id and text
    return left.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hits(docs, Index(docs, table(spark, sf_dir, "benchmark"), 10)).where("n_hit = 0").select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span is replaced by its kind in brackets; n_chars follows."""
    rows = wrapped(docs).join(span_lists(docs).hint("merge"), ["d", "h"], "left")
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(redacted(F.col("row.text"), F.col("found")))
    rows = rows.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        size = F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.length("row.text").cast(docs.schema["n_chars"].dataType))
        rows = rows.withColumn("row", F.col("row").withField("n_chars", size))
    return rows.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_path("byte_bpe_50k.json"), end=2, capacity=1024, chunks=CHUNKS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: The classifier, exchange of spans and tokeniser can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
