"""Components of link tables, and the joins they are made of, against plain code."""

import random

from pyspark.sql import functions as F

from cellarium.llm.common import stored, skewed
from cellarium.llm.components import components


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_join_without_heavy_keys_is_one_join_without_a_broadcast(spark):
    rows = spark.range(4000).select((F.col("id") % 2000).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    even = skewed(rows, side, "k", "n", 4000)
    assert "broadcast" not in plan(even) and plan(even).count("Join ") == 1
    hot = rows.union(spark.range(50).select(F.lit(7).cast("long"), "id"))
    side = stored(hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "side")
    uneven = skewed(hot, side, "k", "n", 4050)
    assert "broadcast" in plan(uneven)
    assert sorted(uneven.select("k", "id", "top").collect()) == sorted(hot.join(side, "k").select("k", "id", "top").collect())


def test_components_of_hubs_chains_and_loose_pairs(spark):
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
