"""Operator 2, URL filter, in DataFrame functions only: host and path rules, and for the rest a logistic regression.

The model's inputs are hashed character n-grams of host and path. It is trained by gradient steps, each one aggregation
over a small labelled table, of whose gradient at most `buckets` numbers reach the driver.

Edge cases: a null url, or one without `://`, has an empty host and path and no n-grams beyond the marks around them;
repeated rows are judged each; without labelled rows the model allows; an empty table gives no row; further columns
are not read.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

BUCKETS, GRAM, LABELLED, STEPS = 2048, 3, 2000, 24


def parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. rules: (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        at, _, rest = r.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, r).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of ^host$ and ^path$."""
    def of(text: Column, mark: str) -> Column:
        s = F.concat(F.lit(mark + "^"), text, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(s) - GRAM + 1), lambda i: F.pmod(F.xxhash64(F.concat(F.lit(mark), F.substring(s, i, F.lit(GRAM)))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(of(host, "h"), of(path, "p")))


def logit(index: Column, weights: list[float], bias: float) -> Column:
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # one literal, folded once
    return F.aggregate(index, F.lit(0.0), lambda a, i: a + F.get(w, i)) / F.sqrt(F.size(index).cast("double")) + bias


def train(labelled: DataFrame, steps: int = STEPS, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Weights by bucket and the bias; labelled: columns host, path, y (1: block). Steps scaled as by Adagrad."""
    rows = stored(labelled.select(F.col("y").cast("double").alias("y"), grams(F.col("host"), F.col("path")).alias("index")), "labelled")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    weights, bias, seen = [0.0] * BUCKETS, 0.0, [1e-8] * (BUCKETS + 1)
    if not 0 < positive < n:
        return weights, 6.0 if n and positive else -6.0
    for _ in range(steps):
        miss = 1 / (1 + F.exp(-logit(F.col("index"), weights, bias))) - F.col("y")
        each = rows.select((miss / F.sqrt(F.size("index").cast("double"))).alias("g"), miss.alias("m"), F.explode(F.concat("index", F.array(F.lit(BUCKETS)))).alias("i"))
        sums = each.groupBy("i").agg(F.sum(F.when(F.col("i") == BUCKETS, F.col("m")).otherwise(F.col("g"))).alias("g")).collect()
        for r in sums:
            i, g = r["i"], r["g"] / n
            if i < BUCKETS:
                g += ridge * weights[i]
            seen[i] += g * g
            step = 0.5 * g / sqrt(seen[i])
            if i == BUCKETS:
                bias -= step
            else:
                weights[i] -= step
    return weights, bias


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, most: int = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block.

    labelled: a small table (url, label: block or allow). By default the urls of pages that a rule decides, at most
    `most` of each verdict, those with the smallest hash.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "decided": verdict})
    if labelled is None:
        known = rows.where(F.col("decided").isNotNull()).select("host", "path", F.col("decided").alias("label"))
        few = [known.where(F.col("label") == v).orderBy(F.xxhash64("host", "path"), "host", "path").limit(most) for v in ("allow", "block")]
        table = few[0].union(few[1])
    else:
        table = labelled.select(*[c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path"), strict=True)], "label")
    weights, bias = train(table.where(F.col("label").isin("allow", "block")).select("host", "path", (F.col("label") == "block").cast("int").alias("y")))
    p = 1 / (1 + F.exp(-logit(grams(F.col("host"), F.col("path")), weights, bias)))
    out = rows.withColumn("p_block", p)
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "p_block")
