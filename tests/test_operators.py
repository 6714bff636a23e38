"""Operators that SQL can't state, against plain code on small inputs."""

import itertools

import numpy as np
import pytest

from cellarium.operators import graph, masks, nearest, partition, rays
from tests.test_queries import naive_contract


def groups(labels: dict) -> set:
    out = {}
    for k, v in labels.items():
        out.setdefault(v, set()).add(k)
    return set(map(frozenset, out.values()))


def random_edges(seed: int, n: int, share: float, mean: float) -> list:
    rng = np.random.default_rng(seed)
    return [(u, v, float(rng.normal(mean))) for u, v in itertools.combinations(range(n), 2) if rng.random() < share]


@pytest.mark.parametrize("hole", [False, True])
def test_enclose(spark, hole):
    """A closed hollow cube encloses what is in it; through a hole the outside is reached."""
    number = {p: i for i, p in enumerate(itertools.product(range(12), repeat=3))}
    cells = spark.createDataFrame([(i, *map(float, p)) for p, i in number.items()], "id long, x double, y double, z double")
    edges = [(i, number[q]) for p, i in number.items() for k in range(3) if (q := (*p[:k], p[k] + 1, *p[k + 1 :])) in number]
    shell = {i for p, i in number.items() if min(p) >= 1 and max(p) <= 10 and (min(p) == 1 or max(p) == 10)} - ({number[5, 5, 1]} if hole else set())
    got = {r.id for r in graph.enclose(spark.createDataFrame([(i,) for i in shell], "id long"), cells, spark.createDataFrame(edges, "u long, v long")).collect()}
    want = set() if hole else {i for p, i in number.items() if min(p) >= 2 and max(p) <= 9}
    assert got == want
    rows = graph.volume(spark.createDataFrame([(i,) for i in shell], "id long"), cells, spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.id for r in rows if r.part == "interior"} == want and {r.id for r in rows if r.part == "shell"} == shell and {r.leaks for r in rows} == {hole}


@pytest.mark.parametrize("safe", [None, 2.5])
def test_multicut(spark, safe):
    edges = random_edges(3, 24, 0.3, -0.2)
    if safe:  # edges above `safe` are contracted first, whatever follows
        start = {n: n for n in range(24)}
        for u, v, w in edges:
            if w > safe:
                start = {n: start[u] if c == start[v] else c for n, c in start.items()}
        inner = naive_contract([(start[u], start[v], w) for u, v, w in edges])
        want = {n: inner.get(c, c) for n, c in start.items()}
    else:
        want = {n: n for n in range(24)} | naive_contract(edges)
    nodes = spark.createDataFrame([(n,) for n in range(24)], "id long")
    got = {r.id: r.label for r in partition.multicut(nodes, spark.createDataFrame(edges, "u long, v long, w double"), safe=safe).collect()}
    assert groups(got) == groups(want)


def rounds_by_hand(edges: list) -> dict:
    comp = {n: n for e in edges for n in e[:2]}
    while True:
        sums, top = {}, {}
        for u, v, w in edges:
            a, b = sorted((comp[u], comp[v]))
            if a != b:
                sums[a, b] = sums.get((a, b), 0) + w
        for (a, b), w in sums.items():
            if w > 0:
                for n in (a, b):
                    top[n] = max(top.get(n, (0,)), (w, -a, -b))
        pairs = [(a, b) for (a, b), w in sums.items() if top.get(a) == top.get(b) == (w, -a, -b)]
        if not pairs:
            return comp
        to = {b: a for a, b in pairs}
        comp = {n: to.get(c, c) for n, c in comp.items()}


@pytest.mark.parametrize("planted", [False, True])
def test_multicut_in_rounds(spark, planted):
    """Equal to the rule by hand; on planted parts, equal to the sequential greedy too, with all attraction in one component."""
    if planted:
        rng = np.random.default_rng(6)
        edges = [(u, v, float(rng.uniform(0.5, 2) if u // 12 == v // 12 else rng.normal(-0.6, 0.4))) for u, v in itertools.combinations(range(48), 2) if rng.random() < 0.5]
    else:
        edges = random_edges(3, 24, 0.3, -0.2)
    want = rounds_by_hand(edges)
    got = {r.id: r.label for r in partition.multicut_rounds(spark.range(48 if planted else 24), spark.createDataFrame(edges, "u long, v long, w double")).collect()}
    assert groups({n: got[n] for n in want}) == groups(want)
    greedy = naive_contract(edges)
    cost = lambda comp: sum(w for u, v, w in edges if comp[u] != comp[v])
    assert groups(want) == groups(greedy) if planted else cost(want) <= 0.9 * cost(greedy)


def inner_difference(members: set, edges: list) -> float:
    """The greatest edge of a minimum spanning tree of a component."""
    tree, top = {n: {n} for n in members}, 0.0
    for d, u, v in sorted((d, u, v) for u, v, d in edges if u in members and v in members):
        if tree[u] is not tree[v]:
            tree[u] |= tree[v]
            for n in tree[u]:
                tree[n] = tree[u]
            top = d
    return top


def test_felzenszwalb(spark):
    edges = [(u, v, abs(w)) for u, v, w in random_edges(4, 20, 0.35, 0.0)]
    of = {n: {n} for n in range(21)}
    for d, u, v in sorted((d, u, v) for u, v, d in edges):
        a, b = of[u], of[v]
        if a is not b and d <= min(inner_difference(c, edges) + 0.6 / len(c) for c in (a, b)):
            for n in (both := a | b):
                of[n] = both
    nodes = spark.createDataFrame([(n,) for n in range(21)], "id long")
    got = {r.id: r.label for r in partition.felzenszwalb(nodes, spark.createDataFrame(edges, "u long, v long, d double"), k=0.6).collect()}
    assert groups(got) == set(map(frozenset, of.values())) and 1 < len(groups(got)) < 21


def test_mixtures_find_planted_parts(spark):
    rng = np.random.default_rng(5)
    same = rng.random(4000) < 0.7
    agree = rng.binomial(6, np.where(same, 0.9, 0.2))
    pairs, n = np.unique(agree, return_counts=True)
    votes = spark.createDataFrame([(int(a), int(6 - a), int(c)) for a, c in zip(pairs, n)], "agree long, disagree long, n long")
    found = partition.bernoulli_mixture(votes)
    assert all(abs(found[k] - x) < 0.03 for k, x in {"pi": 0.7, "alpha": 0.9, "beta": 0.2}.items())
    d = np.exp(np.concatenate([rng.normal(-2, 0.3, 1200), rng.normal(1, 0.5, 800)]))
    parts = partition.gaussian_mixture(spark.createDataFrame([(float(x),) for x in d], "d double"), rounds=15)
    assert np.allclose(parts, [(0.6, -2, 0.3), (0.4, 1, 0.5)], atol=0.06)


def test_suppression(spark):
    rng = np.random.default_rng(6)
    sizes = [(f, o, int(rng.integers(0, 9)), float(rng.integers(0, 5)) / 4) for f in range(3) for o in range(12)]
    ious = {(f, a, b): float(rng.random()) * 0.25 for f in range(3) for a, b in itertools.combinations(range(12), 2)}
    want = set()
    for f in range(3):
        kept = []
        for _, o in sorted((-s, o) for g, o, n, s in sizes if g == f and n >= 1):
            if len(kept) < 5 and all(ious[f, min(o, k), max(o, k)] <= 0.1 for k in kept):
                kept.append(o)
        want |= {(f, o, i) for i, o in enumerate(kept)}
    got = masks.select_masks(spark.createDataFrame(sizes, "frame_idx long, obj_id long, n long, score double"), spark.createDataFrame([(*k, x) for k, x in ious.items()], "frame_idx long, a long, b long, iou double"))
    assert {tuple(r) for r in got.collect()} == want


def test_tour_and_best_union(spark):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(9, 3))
    order = [0]
    while len(order) < 9:
        order.append(min(set(range(9)) - {*order}, key=lambda j: np.linalg.norm(p[j] - p[order[-1]])))
    got = masks.tour(spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "scene long, id long, x double, y double, z double")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == order
    # target 1 has 10: 6 of 6, 3 of 4, then 1 of 30, which would lower the union's IoU of 9 / 11
    overlap = [(1, 1, 6, 6, 10), (1, 2, 3, 4, 10), (1, 3, 1, 30, 10), (2, 9, 0, 5, 4)]
    got = masks.best_union(spark.createDataFrame(overlap, "target long, pred long, both_n long, n long, target_n long")).collect()
    assert {tuple(r) for r in got} == {(1, 2, round(9 / 11, 6)), (2, 0, 0.0)}


def test_average_precision(spark):
    rng = np.random.default_rng(9)
    rows = [(i, None if rng.random() < 0.2 else int(g), int(g if rng.random() < 0.5 + g / 30 else rng.integers(0, 14))) for i, g in enumerate(rng.integers(0, 12, 3000))]
    gts, preds = ({k: {r[0] for r in rows if r[c] == k} for k in {r[c] for r in rows} - {None}} for c in (1, 2))
    gts, preds = ({k: s for k, s in x.items() if len(s) >= 40} for x in (gts, preds))
    void = {r[0] for r in rows if r[1] is None}

    def ap(t: float) -> float:
        free, hits = set(gts), []
        for p in sorted(preds, key=lambda p: (-len(preds[p]), p)):
            best = max(((len(preds[p] & gts[g]) / len(preds[p] | gts[g]), -g) for g in free), default=(0, 0))
            if best[0] >= t:
                free.discard(-best[1])
                hits.append(1)
            elif len(preds[p] & void) / len(preds[p]) <= t:
                hits.append(0)
        right = np.cumsum(hits)
        precision = right / np.arange(1, len(hits) + 1)
        return sum(h * precision[i:].max() for i, h in enumerate(hits)) / len(gts)

    got = masks.average_precision(spark.createDataFrame(rows, "vertex_id long, gt_id long, pred_id long"), min_size=40).first()
    want = np.mean([ap(x / 100) for x in range(50, 95, 5)]), ap(0.5), ap(0.25)
    assert np.allclose(got, want, atol=1e-5) and 0 < want[0] < want[2]


def test_fisher_threshold(spark):
    rng = np.random.default_rng(10)
    inside = rng.random(400) < 0.2
    p = rng.normal(inside * 2.0)
    cuts = np.linspace(*np.quantile(p, [0.5, 0.9995]), 80)
    iou = [float((inside & (p >= c)).sum() / (inside | (p >= c)).sum()) for c in cuts]
    got = masks.fisher_threshold(spark.createDataFrame([(i, bool(a), float(x)) for i, (a, x) in enumerate(zip(inside, p))], "id long, inside boolean, p double")).first()
    assert abs(got.cut - cuts[int(np.argmax(iou))]) < 1e-9 and abs(got.iou - max(iou)) < 1e-9


def test_nearest_points(spark):
    """Crowded and lonely places, copies, queries outside the points' box, and fewer points than asked for."""
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.normal(0, 0.01, (300, 3)), rng.uniform(-5, 5, (100, 3)), np.zeros((20, 3)), [[60.0, 0, 0]]])
    q = np.concatenate([p[::7], rng.uniform(-9, 9, (20, 3)), [[200.0, 1, 1]]])
    table = lambda x, name: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{name} long, x double, y double, z double")
    for k in (1, 8):
        got = {}
        for r in nearest.nearest(table(p, "id"), table(q, "q"), k, crowd=8).collect():
            got.setdefault(r.q, {})[r.rank] = (r.id, round(r.d, 9))
        for i, v in enumerate(q):
            d = np.sqrt(((p - v) ** 2).sum(1))
            want = np.lexsort((np.arange(len(p)), d))[:k]
            assert got[i] == {j + 1: (int(n), round(float(d[n]), 9)) for j, n in enumerate(want)}
    few = nearest.nearest(table(p[:3], "id"), table(q[:4], "q"), 8)
    assert few.count() == 12 and nearest.nearest(table(p, "id").limit(0), table(q, "q"), 2).count() == 0


def test_bases_and_projections(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 5)) @ np.diag([5, 3, 2, 0.5, 0.1]) + 7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    mean, basis = rays.principal(rows, rows.f, 5)
    u = np.linalg.svd(x - x.mean(0))[2][:3].T
    assert np.allclose(mean, x.mean(0)) and np.allclose(basis @ basis.T, u @ u.T, atol=1e-8)
    p = (x - mean) @ basis
    lo, hi = np.quantile(p, [0.02, 0.98], axis=0)
    want = np.floor(255 * np.clip((p - lo) / (hi - lo), 0, 1))
    got = np.array([(r.r, r.g, r.b) for r in rays.projected_rgb(rows, rows.f, 5).orderBy("id").collect()])
    assert (np.abs(got - want) <= 1).all() and (got == want).mean() > 0.99
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]  # cameras that pan about one axis
    angles = rng.uniform(0, 6, 40)
    right, forward = (np.stack([f(angles), g(angles) * s, 0 * angles], 1) @ turn.T for f, g, s in ((np.cos, np.sin, 1), (np.sin, np.cos, -1)))
    down = np.tile(-turn[:, 2], (40, 1))
    up = rays.up_direction(spark.createDataFrame([tuple(v.tolist() for v in r) for r in zip(right, down, forward)], "right array<double>, down array<double>, forward array<double>"))
    assert np.allclose(up, turn[:, 2], atol=1e-6)


def test_evidence_from_votes_and_distances(spark):
    """Weights against plain code, edge by edge."""
    rng = np.random.default_rng(13)
    n = 600
    same = rng.random(n) < 0.6
    d = np.where(same, rng.uniform(0, 0.5, n), rng.uniform(0.3, 1, n))
    agree, disagree = rng.binomial(5, np.where(same, 0.9, 0.2)), rng.binomial(2, 0.5, n)
    seen = rng.random(n) < 0.8
    solid = rng.random(n)
    edges = spark.createDataFrame([(i, i + n, float(a), float(b)) for i, (a, b) in enumerate(zip(d, solid))], "u long, v long, d double, solid double")
    votes = spark.createDataFrame([(i, i + n, int(agree[i]), int(disagree[i])) for i in range(n) if seen[i]], "u long, v long, agree long, disagree long")
    part = partition.bernoulli_mixture(votes.groupBy("agree", "disagree").count().withColumnRenamed("count", "n"))
    prior = np.log(part["pi"] / (1 - part["pi"]))
    llr = np.clip(agree * np.log(part["alpha"] / part["beta"]) + disagree * np.log((1 - part["alpha"]) / (1 - part["beta"])), -24, 24) * seen
    observed = seen & (agree + disagree > 0)
    p = 1 / (1 + np.exp(-(llr + prior)))
    w = llr + prior
    for x, bins in ((d, 64), (solid, 32)):
        bin_ = np.searchsorted(np.quantile(x[observed], np.arange(1, bins) / bins), x, "right")
        for b in range(bins):
            own = observed & (bin_ == b)
            w = w + (bin_ == b) * np.clip(np.log((p[own].sum() + 1) / ((1 - p[own]).sum() + 1)), -12, 12)
    got = {r.u: r.w for r in partition.evidence(edges, votes, solidity=True).collect()}
    assert np.allclose([got[i] for i in range(n)], np.clip(w, -48, 48), atol=1e-6)
    nodes = spark.range(2 * n)
    labels = {r.id: r.label for r in partition.partition("multicut_votes", nodes, edges, 1, votes, solidity=1).collect()}
    assert all((labels[i] == labels[i + n]) == (got[i] > 0) for i in range(n))  # every edge is alone
    for method, options in (("threshold", {"tau": 0.4}), ("multicut", {"tau": 0.4})):
        labels = {r.id: r.label for r in partition.partition(method, nodes, edges, 1, **options).collect()}
        assert all((labels[i] == labels[i + n]) == (d[i] < 0.4) for i in range(n))
    with pytest.raises(ValueError):
        partition.partition("unknown", nodes, edges)


def test_scenes_are_scored_apart(spark):
    rng = np.random.default_rng(14)
    rows = [(i, int(s), int(g), int(g if rng.random() < 0.7 else rng.integers(0, 5))) for i, (s, g) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 5, 900)))]
    got = {r.scene: (r.ap, r.ap50, r.ap25) for r in masks.average_precision(spark.createDataFrame(rows, "vertex_id long, scene long, gt_id long, pred_id long"), min_size=10).collect()}
    for s in range(3):
        alone = spark.createDataFrame([(i, g, p) for i, x, g, p in rows if x == s], "vertex_id long, gt_id long, pred_id long")
        assert got[s] == tuple(masks.average_precision(alone, min_size=10).first())
