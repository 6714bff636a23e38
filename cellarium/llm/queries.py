"""The operators' queries, in the form their contracts ask for, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import token_shards

    return token_shards(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end=1)


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"), RULES)


def op3_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, within=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end=2, capacity=1024)


def op6_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def op7_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import score

    return score(table(spark, sf_dir, "documents"))


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, joined_spans, with_spans

    found = with_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: (s["kind"] == k) & s["base"])).cast("long").alias(f"n_{k}")
    base = joined_spans(F.filter("found", lambda s: s["base"]))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    found = whiten(table(spark, sf_dir, "embeddings"), most=8).withColumnRenamed("id", "vec_id")
    each = found.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"), "n", "deviation", "identity_error")
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), most_words=3, min_count=10, covered=50, most=2000)


def op13_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT l FROM win),
grams AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - l + 2)) t(p)),
hit AS (SELECT doc_id, item_id, p, win.l FROM grams JOIN win USING (l, g)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + l)) t(q) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
words AS (SELECT doc_id, w[p] AS word, p FROM d, unnest(range(1, len(w) + 1)) t(p)),
freq AS (SELECT word, count(*) AS df FROM words GROUP BY word),
own AS (SELECT item_id, word, coalesce(df, 0) AS df FROM (SELECT DISTINCT item_id, unnest(w) AS word FROM b) x LEFT JOIN freq USING (word)),
rare AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY df, word) AS k, min(df) OVER (PARTITION BY item_id) AS least, count(*) OVER (PARTITION BY item_id) AS n FROM own),
anchor AS (SELECT item_id, least(n, 4) AS n, doc_id, p FROM rare JOIN words USING (word) WHERE k = 1 AND least > 0),
close AS (SELECT a.item_id, a.doc_id, a.p, any_value(a.n) AS n, count(DISTINCT r.word) AS met FROM anchor a JOIN rare r ON r.item_id = a.item_id AND r.k <= a.n JOIN words x ON x.doc_id = a.doc_id AND x.word = r.word AND abs(x.p - a.p) <= 20 GROUP BY a.item_id, a.doc_id, a.p),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close WHERE met = n GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    ((instr('0123456789abcdef', substr(h, CAST(1 + (5 * i) // 4 AS INT), 1)) - 1) * 16
      + instr('0123456789abcdef', substr(h, CAST(2 + (5 * i) // 4 AS INT), 1)) - 1) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM m
"""

OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g, count(*) AS a FROM lists, unnest(range(1, 4)) s(m), unnest(range(1, len(w) - m + 2)) t(i) GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, a, string_split(g, ' ') AS w FROM f WHERE m >= 2 AND a >= 10),
cuts AS (SELECT c.lang, c.m, c.g, c.a, k, x.a AS l, y.a AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM c, unnest(range(1, c.m)) t(k) JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS g, max(a) AS top FROM c, unnest(range(1, 3)) t(i) WHERE m = 3 GROUP BY ALL),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.g)) AS rank, b.g AS phrase, a, l, r, score
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g AND b.m = 2 WHERE top IS NULL OR 100 * top < 50 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_repair_tokens, op2_url_logistic, op3_simhash_popcount, op4_additive_quality, op5_bin_completion, op6_positional_decontamination, op7_brown_score, op8_additive_quantisation, op9_boosted_pii, op10_warc_salvage, op11_whitening, op12_pair_naming, op13_quartile_digest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_positional_decontamination": OP6_SQL, "op10_warc_salvage": OP10_SQL, "op12_pair_naming": OP12_SQL}
