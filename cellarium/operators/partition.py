"""Partitions of weighted graphs (G4-G9) and the mixtures behind their weights."""

from __future__ import annotations

import heapq
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.operators.graph import beside, connected_components, durable, relabel, threshold_components


def contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy additive contraction of one component's edges (u, v, w): the heaviest positive edge is contracted and parallel edges summed until none is positive."""
    weights: dict = {}
    for u, v, w in pdf[["u", "v", "w"]].itertuples(index=False, name=None):
        weights.setdefault(u, {})
        weights.setdefault(v, {})
        weights[u][v] = weights[u].get(v, 0.0) + w
        weights[v][u] = weights[v].get(u, 0.0) + w
    root = {n: n for n in weights}
    heap = [(-w, u, v) for u, near in weights.items() for v, w in near.items() if u < v and w > 0]
    heapq.heapify(heap)
    while heap:
        w, u, v = heapq.heappop(heap)
        if u not in weights or weights[u].get(v) != -w:
            continue
        for n, x in weights.pop(v).items():
            del weights[n][v]
            if n != u:
                new = weights[u].get(n, 0.0) + x
                weights[u][n] = weights[n][u] = new
                if new > 0:
                    heapq.heappush(heap, (-new, min(u, n), max(u, n)))
        root[v] = u
    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    return pd.DataFrame({"id": list(root), "comp": [find(n) for n in root]})


def multicut(nodes: DataFrame, edges: DataFrame, min_size: int = 1, safe: float | None = None) -> DataFrame:
    """Labels (id, label) of a multicut of edges (u, v, w). Edges with w above `safe` are contracted first, by components.

    A sum of parallel edges is positive only if one of them is, so nothing crosses a component of positive edges: each
    such component is one group. `safe` keeps groups small where attraction percolates.
    """
    base = connected_components(nodes, edges.where(F.col("w") > safe)) if safe is not None else nodes.select("id", F.col("id").alias("comp"))
    a, b = base.select(F.col("id").alias("u"), F.col("comp").alias("cu")), base.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    lifted = edges.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where("cu <> cv")
    lifted = lifted.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w"))
    supers = base.select(F.col("comp").alias("id")).distinct()
    group = connected_components(supers, lifted.where("w > 0"))
    own = lifted.join(group.select(F.col("id").alias("u"), F.col("comp").alias("gu")).hint("merge"), "u").join(group.select(F.col("id").alias("v"), F.col("comp").alias("gv")).hint("merge"), "v").where("gu = gv")
    merged = own.groupBy("gu").applyInPandas(contract, "id long, comp long")
    final = base.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")).hint("merge"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    least = final.groupBy("comp").agg(F.min("id").alias("least"))
    return relabel(final.join(least.hint("merge"), "comp").select("id", F.col("least").alias("comp")), min_size)


def multicut_rounds(nodes: DataFrame, edges: DataFrame, min_size: int = 1) -> DataFrame:
    """Labels (id, label) of a multicut of edges (u, v, w) in parallel rounds; no task holds a component.

    A round contracts every positive edge that is the heaviest at both its ends, ties to the least ends, and sums edges that
    become parallel, until none is positive. The sequential greedy takes these edges too, but one at a time: a contraction
    elsewhere may come first there and change an edge's sum, so on some graphs the two part differently.
    """
    cut = edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))
    cut, comps = durable(cut), nodes.select("id", F.col("id").alias("comp")).distinct()
    while True:
        rank = F.struct("w", (-F.col("u")).alias("a"), (-F.col("v")).alias("b"))
        rising = cut.where("w > 0")
        ends = rising.select(F.col("u").alias("end"), rank.alias("r")).union(rising.select("v", rank))
        top = ends.groupBy("end").agg(F.max("r").alias("r")).select((-F.col("r.a")).alias("u"), (-F.col("r.b")).alias("v"))
        pairs = durable(top.groupBy("u", "v").count().where("count = 2").select("u", "v"))
        n = pairs.count()
        if not n:
            break
        move = beside(pairs.select(F.col("v").alias("gone"), F.col("u").alias("to")), n)
        for end in "uv":
            cut = cut.join(move.withColumnRenamed("gone", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        cut = durable(cut.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w")))
        comps = durable(comps.join(move.withColumnRenamed("gone", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
    return relabel(comps, min_size)


def felzenszwalb(nodes: DataFrame, edges: DataFrame, k: float = 0.02, min_size: int = 1) -> DataFrame:
    """Merges along edges (u, v, d) in ascending order where d is at most both sides' greatest inner edge plus k over their size.

    Merges never leave a connected component, so each one is a group.
    """
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        root = {n: n for n in {*pdf["u"], *pdf["v"]}}
        inner, size = dict.fromkeys(root, 0.0), dict.fromkeys(root, 1)
        def find(n):
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n
        for u, v, d in pdf.sort_values(["d", "u", "v"])[["u", "v", "d"]].itertuples(index=False, name=None):
            a, b = find(u), find(v)
            if a != b and d <= min(inner[a] + k / size[a], inner[b] + k / size[b]):
                a, b = min(a, b), max(a, b)
                root[b] = a
                inner[a], size[a] = d, size[a] + size[b]
        return pd.DataFrame({"id": list(root), "comp": [find(n) for n in root]})

    group = connected_components(nodes, edges)
    own = edges.join(group.select(F.col("id").alias("u"), "comp").hint("merge"), "u")
    merged = own.groupBy("comp").applyInPandas(merge, "id long, comp long")
    alone = nodes.join(merged.select("id").hint("merge"), "id", "left_anti").select("id", F.col("id").alias("comp"))
    return relabel(merged.union(alone), min_size)


def bernoulli_mixture(counts: DataFrame, rounds: int = 80) -> dict[str, float]:
    """Two-component EM over vote pairs. counts: agree, disagree, n - a row for each pair of counts, which loses nothing; pairs without a vote say nothing."""
    rows = counts.where("agree + disagree > 0").orderBy("agree", "disagree").toPandas()
    a, d, n = (rows[c].to_numpy(float) for c in ("agree", "disagree", "n"))
    pi, alpha, beta = 0.9, 0.95, 0.15
    for _ in range(rounds if len(rows) else 0):
        same = np.log(pi) + a * np.log(alpha) + d * np.log1p(-alpha)
        other = np.log1p(-pi) + a * np.log(beta) + d * np.log1p(-beta)
        r = 1 / (1 + np.exp(np.clip(other - same, -60, 60)))
        clip = lambda x, low: float(np.clip(x, low, 1 - low))
        pi = clip((n * r).sum() / n.sum(), 1e-4)
        alpha = clip((n * r * a).sum() / max((n * r * (a + d)).sum(), 1e-12), 1e-3)
        beta = clip((n * (1 - r) * a).sum() / max((n * (1 - r) * (a + d)).sum(), 1e-12), 1e-3)
    return {"pi": pi, "alpha": alpha, "beta": beta}


def gaussian_mixture(values: DataFrame, rounds: int = 60) -> list[tuple[float, float, float]]:
    """Two Gaussians on the logarithm of column d, ordered by mean: (weight, mean, sd). One aggregation a round, over all rows."""
    x = durable(values.where("d + 1e-6 > 0 and not isnan(d) and d < double('inf')").select(F.ln(F.col("d") + 1e-6).alias("x")))  # read once a round
    lo, hi, sd = x.agg(F.percentile("x", F.lit(0.1)), F.percentile("x", F.lit(0.9)), F.stddev_pop("x")).first()
    if lo is None:
        return []
    parts = [(0.5, m, sd / 2 + 1e-6) for m in (lo, hi)]
    for _ in range(rounds):
        r = 1 / (1 + F.exp(F.greatest(F.least(log_density(F.col("x"), parts[1]) - log_density(F.col("x"), parts[0]), F.lit(700.0)), F.lit(-700.0))))
        # sums about the means of the round before, so that narrow parts far from zero keep their digits
        each = [(c * w) for c, (_, m, _) in ((F.col("r"), parts[0]), (1 - F.col("r"), parts[1])) for w in (F.lit(1.0), F.col("x") - m, (F.col("x") - m) ** 2)]
        got = x.select("x", r.alias("r")).agg(F.count(F.lit(1)), *map(F.sum, each)).first()
        new = []
        for j, (_, m, _) in enumerate(parts):
            n, s1, s2 = got[1 + 3 * j : 4 + 3 * j]
            n = n + 1e-12
            new.append((n / got[0], m + s1 / n, max(s2 / n - (s1 / n) ** 2, 0.0) ** 0.5 + 1e-6))
        done = max(abs(p[i] - q[i]) for p, q in zip(parts, new, strict=True) for i in range(3)) < 1e-12
        parts = new
        if done:
            break
    return sorted(parts, key=lambda p: p[1])


def log_density(x: Column, part: tuple[float, float, float]) -> Column:
    w, m, s = part
    return log(w + 1e-300) - log(s) - 0.5 * ((x - m) / s) ** 2


CLIP = {"votes": 24.0, "bins": 12.0, "sum": 48.0}


def clipped(x: Column, by: float) -> Column:
    return F.greatest(F.least(x, F.lit(by)), F.lit(-by))


def distance_log_odds(edges: DataFrame) -> DataFrame:
    """edges (u, v, d, ...) with w: log odds of one object against two, from a mixture of the distances alone (G7); the lowest where d isn't finite."""
    same, other = gaussian_mixture(edges)
    x = F.ln(F.col("d") + 1e-6)
    fine = (F.col("d") + 1e-6 > 0) & ~F.isnan("d") & (F.col("d") < float("inf"))  # NaN is the largest number in comparisons
    return edges.withColumn("w", F.when(fine, clipped(log_density(x, same) - log_density(x, other), CLIP["votes"])).otherwise(-CLIP["votes"]))


def vote_log_odds(votes: DataFrame) -> tuple[DataFrame, float]:
    """votes (u, v, agree, disagree) with llr and the posterior p (null where nothing was observed), and the prior's log odds."""
    part = bernoulli_mixture(votes.groupBy("agree", "disagree").agg(F.count(F.lit(1)).alias("n")))
    prior, a, b = log(part["pi"] / (1 - part["pi"])), part["alpha"], part["beta"]
    llr = clipped(F.col("agree") * log(a / b) + F.col("disagree") * log((1 - a) / (1 - b)), CLIP["votes"])
    rows = votes.withColumn("llr", llr)
    return rows.withColumn("p", F.when(F.col("agree") + F.col("disagree") > 0, 1 / (1 + F.exp(-(F.col("llr") + prior))))), prior


def calibrated(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """rows (u, v, p, column) with `evidence`: the smoothed log ratio of the soft labels p in the quantile bin of the column.

    Edges are quantiles of observed rows; a bin without any has no evidence. Rows beyond the edges fall in the outer bins.
    """
    cuts = rows.where("p is not null").agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0] or []
    edges = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    rows = rows.withColumn("bin", F.size(F.filter(edges, lambda c: c <= F.col(column))))
    tally = rows.where("p is not null").groupBy("bin").agg(clipped(F.ln((F.sum("p") + 1) / (F.sum(1 - F.col("p")) + 1)), CLIP["bins"]).alias("evidence"))
    return rows.join(F.broadcast(tally), "bin", "left").fillna(0.0, ["evidence"])  # at most `bins` rows


def evidence(edges: DataFrame, votes: DataFrame, solidity: bool = False, bins: int = 64, solid_bins: int = 32) -> DataFrame:
    """edges (u, v, d, solid) with w: the votes' log likelihood ratio, what the distance (and the solidity) says, and the prior."""
    seen, prior = vote_log_odds(votes)
    rows = durable(edges.join(seen.select("u", "v", "llr", "p").hint("merge"), ["u", "v"], "left"))
    rows = calibrated(rows, "d", bins).withColumnRenamed("evidence", "by_distance").drop("bin")
    w = F.coalesce("llr", F.lit(0.0)) + F.col("by_distance") + prior
    if solidity:
        rows = calibrated(rows, "solid", solid_bins)
        w = w + F.col("evidence")
    return rows.select("u", "v", "d", clipped(w, CLIP["sum"]).alias("w"))


def partition(method: str, nodes: DataFrame, edges: DataFrame, min_size: int = 1, votes: DataFrame | None = None, **options: float) -> DataFrame:
    """Labels (id, label) by the method's name (G10). edges: u, v, d, solid."""
    if method == "threshold":
        return threshold_components(nodes, edges, options["tau"], min_size)
    if method == "felzenszwalb":
        return felzenszwalb(nodes, edges, options.get("k", 0.02), min_size)
    if method == "multicut":
        tau, w = options["tau"], options["tau"] - F.col("d")
        if options.get("occupancy"):
            top = edges.agg(F.max("solid")).first()[0] or 1.0
            w = w * F.col("solid") / top
        return multicut(nodes, edges.select("u", "v", w.alias("w")), min_size, tau / 2 if not options.get("occupancy") else None)
    if method == "multicut_rounds":
        return multicut_rounds(nodes, edges.select("u", "v", (options["tau"] - F.col("d")).alias("w")), min_size)
    if method == "multicut_logodds":
        return multicut(nodes, distance_log_odds(edges).select("u", "v", "w"), min_size, safe=6.0)
    if method == "multicut_votes" and votes is not None:
        return multicut(nodes, evidence(edges, votes, bool(options.get("solidity"))).select("u", "v", "w"), min_size, safe=6.0)
    raise ValueError(f"unknown method {method!r}")
