"""Tables that grow with the scene are never sent through the driver, however small Spark takes them for."""

import numpy as np
import pytest

from cellarium.operators import graph, nearest, partition, rays


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables written from here on, with no table taken for small."""
    seen, real = [], graph.durable

    def watched(df):
        seen.append(plan(df))
        return real(df)

    for module in (graph, nearest, partition, rays):
        monkeypatch.setattr(module, "durable", watched)
    monkeypatch.setattr(graph, "SMALL", -1)
    return seen


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n=60):
    p = np.random.default_rng(3).normal(size=(n, 3))
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


def test_nearest_broadcasts_no_unrolled_queries(spark, plans):
    cells = points(spark)
    found = nearest.nearest(cells, cells.withColumnRenamed("id", "q"), 3)
    assert found.count() == 180 and not [p for p in [*plans, plan(found)] if "Broadcast" in p]


def test_small_searches_still_broadcast(spark):
    cells = points(spark)
    assert "Broadcast" in plan(nearest.nearest(cells, cells.withColumnRenamed("id", "q"), 3))


def test_components_and_multicuts_broadcast_nothing_that_grows(spark, plans):
    edges = spark.createDataFrame([(i, i + 1, 1.0 if i % 4 else -1.0) for i in range(40)], "u long, v long, w double")
    nodes = spark.range(41).select("id")
    made = [graph.connected_components(nodes, edges), partition.multicut_rounds(nodes, edges), partition.multicut(nodes, edges, safe=0.5)]
    for labels in made[1:]:
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.label, set()).add(r.id)
        assert {min(g) for g in groups.values()} == {0, *range(1, 41, 4)}
    assert not [p for p in [*plans, *map(plan, made)] if "Broadcast" in p]
