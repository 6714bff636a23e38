"""HDBSCAN by rounds and in one block against the definition, on planted data."""

import numpy as np
import pytest

from cellarium.operators import density


def mutual(x: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(k, len(x)) - 1]
    return np.maximum(np.maximum(d, core[:, None]), core)


def parts(m: np.ndarray, at: float, strict: bool, among: set) -> list:
    """Components of the points `among` over pairs of weight below `at`, or at it too."""
    left, out = set(among), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            p = todo.pop()
            seen.add(p)
            near = {q for q in left if (m[p, q] < at if strict else m[p, q] <= at)}
            left -= near
            todo += near
        out.append(seen)
    return out


def by_definition(x, size, k, method="eom", epsilon=0.0):
    """Cuts at every weight from the highest down; clusters are sets of points."""
    m = mutual(np.asarray(x, float), k)
    clusters = []

    def follow(members: set, born: float, parent):
        c = {"parent": parent, "born": born, "all": set(members), "worth": 0.0, "kids": []}
        clusters.append(c)
        inv = lambda w: 1 / max(w, 1e-12)
        birth = 0.0 if parent is None else inv(born)
        now = set(members)
        while now:
            w = max(m[p, q] for p in now for q in now if p != q) if len(now) > 1 else 0.0
            # the weight at which `now` comes apart is the highest of its spanning tree
            ws = sorted({m[p, q] for p in now for q in now if p != q}) or [0.0]
            w = next(t for t in ws if len(parts(m, t, False, now)) == 1)
            big = [s for s in parts(m, w, True, now) if len(s) >= size]
            c["worth"] += (len(now) - sum(map(len, big)) if len(big) < 2 else len(now)) * (inv(w) - birth)
            if len(big) >= 2:
                c["formed"] = w
                c["kids"] = [follow(s, w, c) for s in big]
                return c
            now = big[0] if big else set()
        return c

    if len(x) >= size:
        follow(set(range(len(x))), np.inf, None)
    best = lambda c: max(c["worth"], sum(map(best, c["kids"]))) if c["kids"] else c["worth"]
    chosen = []

    def choose(c):
        below = sum(map(best, c["kids"]))
        if c["parent"] is not None and (not c["kids"] or method == "eom" and below <= c["worth"]):
            chosen.append(c)
        else:
            for kid in c["kids"]:
                choose(kid)

    if clusters:
        choose(clusters[0])
    lifted = []
    for c in chosen:
        while epsilon and c["born"] < epsilon and c["parent"]["parent"] is not None:
            c = c["parent"]
        lifted.append(c)
    top = [c for c in lifted if not any(c is not d and c["all"] < d["all"] for d in lifted)]
    label = {}
    for c in top:
        label |= dict.fromkeys(c["all"], min(c["all"]))
    number = {v: i for i, v in enumerate(sorted(set(label.values())))}
    return [number[label[p]] if p in label else -1 for p in range(len(x))]


def blobs(seed, sizes, spread, d=4, noise=12):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.uniform(-6, 6, d), s, (n, d)) for n, s in zip(sizes, spread)] + [rng.uniform(-9, 9, (noise, d))])


DATA = {
    "apart": blobs(1, [40, 30, 25], [0.4, 0.6, 0.3]),
    "nested": np.concatenate([np.random.default_rng(2).normal(c, 0.25, (22, 3)) for c in ([0, 0, 0], [1.6, 0, 0], [9, 9, 9], [9, 10.5, 9])]),
    "none": np.random.default_rng(3).normal(size=(60, 5)),
    "copies": np.concatenate([np.repeat([[0.0, 0.0], [5.0, 5.0]], [30, 9], axis=0), np.random.default_rng(4).normal(5, 1.5, (40, 2))]),
    "grid": np.array([(a, b) for a in range(6) for b in range(6)] + [(a + 20, b) for a in range(5) for b in range(5)], float),  # many ties
    "line": np.cumsum(np.linspace(0.1, 2, 50))[:, None],  # a chain of ever longer steps
}


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feat array<double>")


@pytest.mark.parametrize("name", list(DATA))
def test_one_block(spark, name):
    x = DATA[name]
    for size, k, method, eps in ((8, 4, "eom", 0.0), (5, 3, "leaf", 0.0), (6, 3, "eom", 1.2)):
        got = {r.id: r.label for r in density.hdbscan(table(spark, x), size, k, method, eps).collect()}
        assert [got[i] for i in range(len(x))] == by_definition(x, size, k, method, eps), (size, k, method)


@pytest.mark.parametrize("name", ["apart", "copies", "grid", "line"])
def test_rounds_equal_the_definition(spark, name):
    x = DATA[name]
    got = {r.id: r.label for r in density.hdbscan(table(spark, x), 8, 4, block=0).collect()}
    assert [got[i] for i in range(len(x))] == by_definition(x, 8, 4)


def test_neighbours_visit_few_pairs(spark):
    x = blobs(5, [120] * 10, [0.3] * 10, d=16, noise=20)
    cells = density.dealt(density.nodes_of(table(spark, x))[0])
    got = {}
    for r in density.feature_neighbours(cells, 5).collect():
        got.setdefault(r.id, {})[r.rank] = r.other
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        assert [got[i][k] for k in range(1, 6)] == np.lexsort((np.arange(len(x)), d[i]))[:5].tolist()
    rows = cells.rows.selectExpr("*", "cast(0.5 as double) reach", "5L k")
    asked = density.block_pairs(cells, density.visits(cells, rows, 5), density.NEAR_Q, density.NEAR_M).selectExpr("sum(q_rows * m_rows)").first()[0]
    assert asked < 0.3 * len(x) ** 2


def test_rows_without_features_and_empty_tables(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 0.0])]
    assert {tuple(r) for r in density.hdbscan(spark.createDataFrame(rows, "id long, feat array<double>"), 2, 2).collect()} == {(1, -1), (2, -1), (3, -1)}
    assert density.hdbscan(spark.createDataFrame([], "id long, feat array<double>"), block=0).collect() == []


def test_sampled_and_augmented(spark):
    x = DATA["apart"]
    cells = spark.createDataFrame([(i, v[:3].tolist(), *map(float, v[1:])) for i, v in enumerate(x)], "id long, feat array<double>, x double, y double, z double")
    wide = density.augmented(cells, with_position=0.5)
    assert wide.first().feat[:3] == [0.5 * v for v in x[0][1:]]
    all_rows = {r.id: r.label for r in density.hdbscan_sampled(wide, min_cluster_size=8, min_samples=4).collect()}
    full = {r.id: r.label for r in density.hdbscan(wide, 8, 4).collect()}
    assert all(all_rows[i] == v for i, v in full.items() if v >= 0) and min(all_rows.values()) >= 0
    assert {r.label for r in density.hdbscan_sampled(table(spark, DATA["none"]), min_cluster_size=25).collect()} == {-1}


def test_query_equals_the_definition(spark):
    from cellarium.plans.queries import REGISTRY, _planted

    rows = sorted((r.id, r.feat) for r in _planted(spark, "/root/testdata/sf0.001").collect())
    want = by_definition(np.array([f for _, f in rows]), 8, 4)
    got = {r.id: r.label for r in REGISTRY["hdbscan_labels"].run(spark, "/root/testdata/sf0.001").collect()}
    order = {v: i for i, v in enumerate(dict.fromkeys(v for v in want if v >= 0))}
    assert [got[i] for i, _ in rows] == [order.get(v, -1) for v in want] and max(want) > 1
