"""Hierarchical density clustering (G13) over exact neighbours in feature space.

Points with equal features are one node with a weight. Nodes are dealt to the cells of seeded pivots; by the triangle
inequality a node visits only the cells that may hold what it looks for, block by block of at most BLOCK rows, so that no
task holds a cell. With these visits come core distances, and then, in rounds, each component's lightest edge to another one
under mutual reachability: the minimum spanning tree of the complete graph.

The hierarchy isn't walked edge by edge. A point leaves its cluster at the weight at which its component reaches the minimum
size; that weight is found by merging small components that choose each other, and by hanging chains of them on large ones.
Edges between components that were large before are the splits; there is at most one for `min_size` points, and the tree
of these alone is ordered in one task. Edges of one weight count at once, so the result doesn't depend on the choice of tree.

A table of at most BLOCK distinct feature vectors is one block, whose tree is made and cut in the one task that holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.operators.graph import connected_components, durable

BLOCK, PIVOTS, LEAST_WEIGHT = 4096, 1024, 1e-12
SLICE = 1 << 21  # differences that a task holds at a time


def nodes_of(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct feature vectors (id, feat, n), id the least, and all (id, node). Rows without finite features have neither."""
    feat = F.col("feat").cast("array<double>")
    fine = feat.isNotNull() & (F.size(feat) > 0) & F.forall(feat, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cells.where(fine).select("id", F.transform(feat, lambda x: x + 0.0).alias("feat"))
    nodes = durable(rows.groupBy("feat").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    return nodes.select(F.col("node").alias("id"), "feat", "n"), rows.join(nodes.select("feat", "node"), "feat").select("id", "node")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of slices of a's rows to all of b, from differences, so that equal pairs have equal distances anywhere."""
    step = max(1, SLICE // max(1, b.size))
    for i in range(0, len(a), step):
        yield slice(i, i + step), np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(axis=2))


@dataclass
class Cells:
    """Nodes by their nearest pivot. Only figures of the at most PIVOTS cells are held by the driver."""

    rows: DataFrame  # id, feat, n, cell, and what is added later
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def dealt(nodes: DataFrame, pivots: int = PIVOTS) -> Cells:
    n = nodes.count()
    chosen = nodes.orderBy(F.xxhash64("id"), "id").select("feat").limit(max(1, min(pivots, int(n**0.5)))).collect()
    at = np.array([r.feat for r in chosen], float).reshape(len(chosen), -1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cell, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for part, d in distances(matrix(rows["feat"]), at):
                cell[part], far[part] = d.argmin(axis=1), d.min(axis=1)
            yield rows.assign(cell=cell, far=far)

    rows = durable(nodes.mapInPandas(place, "id long, feat array<double>, n long, cell int, far double"))
    radius, size = np.zeros(len(at)), np.zeros(len(at), int)
    for r in rows.groupBy("cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("k")).collect():
        radius[r.cell], size[r.cell] = r.r, r.k
    return Cells(rows.drop("far"), at, radius, size)


def packed(columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows in order of their cell as rows (cell, n, a binary for each column) of at most BLOCK of one cell; no more are held."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            cols = {c: [(matrix(rows[c]) if c == "feat" else rows[c].to_numpy()).tobytes()] for c in columns}
            return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "rows": [len(rows)], **cols})

        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                if held and held[0]["cell"].iloc[0] != cell:
                    yield out()
                while len(rows):
                    room = BLOCK - sum(map(len, held))
                    held.append(rows.iloc[:room])
                    rows = rows.iloc[room:]
                    if len(held[-1]) == room:
                        yield out()
        if held:
            yield out()

    return pack


def block_pairs(cells: Cells, queries: DataFrame, own: dict[str, str], theirs: dict[str, str]) -> DataFrame:
    """Blocks of queries (cell to visit, q, feat, ...) beside blocks of that cell's rows. own, theirs: columns and their types."""
    schema = lambda columns, p: ", ".join(["cell int", "rows int", *(f"{c} binary" for c in columns)])
    a = queries.select("cell", *own).repartition("cell").sortWithinPartitions("cell").mapInPandas(packed(list(own)), schema(own, "q"))
    b = cells.rows.select("cell", *theirs).repartition("cell").sortWithinPartitions("cell").mapInPandas(packed(list(theirs)), schema(theirs, "m"))
    return a.select("cell", *[F.col(c).alias(f"q_{c}") for c in ["rows", *own]]).join(b.select("cell", *[F.col(c).alias(f"m_{c}") for c in ["rows", *theirs]]), "cell")


def unpack(row, prefix: str, columns: dict[str, str]) -> dict[str, np.ndarray]:
    out = {c: np.frombuffer(getattr(row, f"{prefix}_{c}"), np.dtype(t)) for c, t in columns.items()}
    out["feat"] = out["feat"].reshape(getattr(row, f"{prefix}_rows"), -1)
    return out


NEAR_Q, NEAR_M = {"id": "i8", "feat": "f8"}, {"id": "i8", "feat": "f8", "n": "i8"}


def nearest_in(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q, m = unpack(row, "q", NEAR_Q), unpack(row, "m", NEAR_M)
                order = np.argsort(m["id"], kind="stable")  # ties in distance go to the least id
                ids, feat, n = m["id"][order], m["feat"][order], m["n"][order]
                for part, d in distances(q["feat"], feat):
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"id": np.repeat(q["id"][part], best.shape[1]), "other": ids[best].ravel(), "n": n[best].ravel(), "d": np.take_along_axis(d, best, 1).ravel()})

    return search


def first_k(rows: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("rank") <= k)


def feature_neighbours(cells: Cells, k: int) -> DataFrame:
    """(id, other, n, d, rank): the k nearest nodes of each, itself included, all if fewer; ties to the least id."""
    found = "id long, other long, n long, d double"
    home = durable(first_k(block_pairs(cells, cells.rows.select("cell", "id", "feat"), NEAR_Q, NEAR_M).mapInPandas(nearest_in(k), found), k))
    reach = home.groupBy("id").agg(F.max("d").alias("reach"), F.count(F.lit(1)).alias("k"))
    away = block_pairs(cells, visits(cells, cells.rows.join(reach, "id"), k), NEAR_Q, NEAR_M).mapInPandas(nearest_in(k), found)
    return first_k(home.drop("rank").union(away), k)


def visits(cells: Cells, rows: DataFrame, k: int) -> DataFrame:
    """(cell, id, feat) for each other cell that may hold one of a row's k nearest. reach: the k-th nearest so far, of k found."""
    pivots, radius, size = cells.pivots, cells.radius, cells.size

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            feat, home, reach, have = matrix(batch["feat"]), batch["cell"].to_numpy(), batch["reach"].to_numpy().copy(), batch["k"].to_numpy()
            for part, d in distances(feat, pivots):
                far = d + radius
                order = np.argsort(far, axis=1)
                enough = np.cumsum(size[order], axis=1) >= k  # so many nodes are no farther than this
                bound = np.where(enough.any(axis=1), np.take_along_axis(far, order, 1)[np.arange(len(d)), enough.argmax(axis=1)], np.inf)
                limit = np.where(have[part] >= k, np.minimum(reach[part], bound), bound)
                go_to = d - radius <= (limit * (1 + 1e-9) + 1e-12)[:, None]
                go_to &= size > 0
                go_to[np.arange(len(d)), home[part]] = False
                who, cell = np.nonzero(go_to)
                who += part.start
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": batch["id"].to_numpy()[who], "feat": list(feat[who])})

    return rows.select("id", "feat", "cell", "reach", "k").mapInPandas(go, "cell int, id long, feat array<double>")


def core_distances(near: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): the distance within which a node has min_samples points, its own first; of the farthest, if fewer."""
    from pyspark.sql import Window

    held = near.withColumn("so_far", F.sum("n").over(Window.partitionBy("id").orderBy("rank")))
    return held.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("so_far") >= min_samples, F.col("d"))), F.max("d")).alias("core"))


EDGE_Q = {"id": "i8", "feat": "f8", "core": "f8", "comp": "i8"}
EDGE = "comp long, w double, u long, v long"


def lightest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each pair of blocks each query component's lightest edge to another component; ties by ends."""
    for batch in batches:
        for row in batch.itertuples():
            q, m = unpack(row, "q", EDGE_Q), unpack(row, "m", EDGE_Q)
            out = []
            for part, d in distances(q["feat"], m["feat"]):
                w = np.maximum(np.maximum(d, q["core"][part, None]), m["core"])
                w[q["comp"][part, None] == m["comp"]] = np.inf
                low = w.min(axis=1, initial=np.inf)
                i, j = np.nonzero((w == low[:, None]) & np.isfinite(low)[:, None])
                a, b = q["id"][part][i], m["id"][j]
                out.append(pd.DataFrame({"comp": q["comp"][part][i], "w": low[i], "u": np.minimum(a, b), "v": np.maximum(a, b)}))
            yield pd.concat(out).sort_values(["comp", "w", "u", "v"]).drop_duplicates("comp")


def spanning_tree(cells: Cells, near: DataFrame, core: DataFrame) -> DataFrame:
    """(u, v, w) of the minimum spanning tree under mutual reachability; ties by ends. One round at least halves the components."""
    spark = core.sparkSession
    listed = near.where("id <> other").select("id", "other", "d").join(core, "id").join(core.select(F.col("id").alias("other"), F.col("core").alias("core2")), "other")
    listed = durable(listed.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"), F.greatest("d", "core", "core2").alias("w")).distinct())
    base = durable(cells.rows.join(core, "id"))
    comps, tree = base.select("id", F.col("id").alias("comp")), None
    while True:
        held = durable(base.join(comps, "id"))
        cell = held.groupBy("cell").agg(*[f(c).alias(n) for n, f, c in (("a", F.min, "comp"), ("b", F.max, "comp"), ("low", F.min, "core"), ("high", F.max, "core"))]).collect()
        whole, low, high = np.full(len(cells.size), -1), np.full(len(cells.size), np.inf), np.full(len(cells.size), np.inf)
        for r in cell:
            whole[r.cell], low[r.cell], high[r.cell] = r.a if r.a == r.b else -1, r.low, r.high
        if len({r.a for r in cell} | {r.b for r in cell}) <= 1:
            break
        listed = durable(listed.join(comps.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u").join(comps.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v").where("cu <> cv").select("u", "v", "w"))
        ends = listed.join(comps.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u").join(comps.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v")
        known = ends.select(F.col("cu").alias("comp"), "w", "u", "v").union(ends.select("cv", "w", "u", "v"))
        bound = durable(known.select("comp", "w").union(held.mapInPandas(upper(cells, whole, high), "comp long, w double")).groupBy("comp").agg(F.min("w").alias("bound")))
        asked = held.join(bound, "comp").where("core <= bound").mapInPandas(crossing(cells, whole, low), "cell int, id long, feat array<double>, core double, comp long")
        around = Cells(held, cells.pivots, cells.radius, cells.size)
        found = block_pairs(around, asked, EDGE_Q, EDGE_Q).mapInPandas(lightest, EDGE)
        best = known.union(found).groupBy("comp").agg(F.min(F.struct("w", "u", "v")).alias("e"))
        best = durable(best.select("e.u", "e.v", "e.w").distinct())
        tree = best if tree is None else tree.union(best)
        joined = best.join(comps.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u").join(comps.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        to = connected_components(comps.select(F.col("comp").alias("id")).distinct(), joined)
        comps = durable(comps.join(to.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp").select("id", F.col("to").alias("comp")))
    return tree.distinct() if tree is not None else spark.createDataFrame([], "u long, v long, w double")


def upper(cells: Cells, whole: np.ndarray, high: np.ndarray):
    """Weights that an edge of each row's component to another one can't exceed."""
    pivots, radius, size = cells.pivots, cells.radius, cells.size

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            comp, core = rows["comp"].to_numpy(), rows["core"].to_numpy()
            w = np.full(len(rows), np.inf)
            for part, d in distances(matrix(rows["feat"]), pivots):
                # a cell of several components holds one that isn't the row's own, but maybe not its own cell's farthest
                other = (size > 0) & (whole != comp[part, None])
                w[part] = np.where(other, np.maximum(np.maximum(d + radius, high), core[part, None]), np.inf).min(axis=1)
            yield pd.DataFrame({"comp": comp, "w": w * (1 + 1e-9)}).groupby("comp", as_index=False).min()

    return go


def crossing(cells: Cells, whole: np.ndarray, low: np.ndarray):
    """Visits of rows to cells with another component within their component's bound."""
    pivots, radius = cells.pivots, cells.radius

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            feat, comp, bound = matrix(rows["feat"]), rows["comp"].to_numpy(), rows["bound"].to_numpy()
            for part, d in distances(feat, pivots):
                limit = bound[part, None]
                who, cell = np.nonzero((whole != comp[part, None]) & (low <= limit) & (d - radius <= limit * (1 + 1e-9) + 1e-12))
                who += part.start
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": rows["id"].to_numpy()[who], "feat": list(feat[who]), "core": rows["core"].to_numpy()[who], "comp": comp[who]})

    return go


def departures(nodes: DataFrame, tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, leaf) of each node: the weight at which its component reaches min_size points (null: never), and that component.
    With it the splits (a, b, w) between leaves.

    A component joins along its lightest edge. Where two small ones choose the same edge they merge; a chain of small ones,
    each of which chooses the next by ever lighter edges, and whose last one chooses a large one, hangs on that one as a whole.
    """
    comps = durable(nodes.select("id", F.col("id").alias("comp"), "n", F.when(F.col("n") >= min_size, F.col("core")).alias("h")))
    edges = durable(tree.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")))
    splits = None
    while True:
        size = comps.groupBy("comp").agg(F.sum("n").alias("size"), (F.count("h") > 0).alias("large"))
        size = durable(size)
        a, b = (size.select(F.col("comp").alias(x), F.col("large").alias(f"{x}_large")) for x in "ab")
        edges = durable(edges.join(a, "a").join(b, "b"))
        apart = edges.where("a_large and b_large").select("a", "b", "u", "v", "w")
        splits = apart if splits is None else splits.union(apart)
        edges = edges.where("not (a_large and b_large)")
        ways = edges.select("a", "b", "w", "u", "v", "a_large").union(edges.select("b", "a", "w", "u", "v", "b_large"))
        choice = ways.where("not a_large").groupBy(F.col("a").alias("comp")).agg(F.min(F.struct("w", "u", "v", F.col("b").alias("to"))).alias("e"))
        choice = durable(choice.select("comp", "e.to", "e.w", "e.u", "e.v"))
        if not choice.limit(1).count():
            break
        ends = choice.join(size.select(F.col("comp").alias("to"), F.col("large").alias("up"), F.col("size").alias("to_size")), "to").join(size.select("comp", "size"), "comp")
        back = choice.select(F.col("comp").alias("to"), F.col("to").alias("comp"), F.lit(True).alias("mutual"))
        ends = durable(ends.join(back, ["comp", "to"], "left"))
        hung = ends.where("up").select("comp", F.col("to").alias("root"))
        loose = ends.where("not up and mutual is null")
        for _ in range(4):  # steps along chains; longer ones go on in the next round
            found = loose.join(hung.select(F.col("comp").alias("to"), "root"), "to")
            hung = hung.union(found.select("comp", "root"))
            loose = loose.join(found.select("comp"), "comp", "left_anti")
        hung = hung.join(ends.select("comp", "w"), "comp").select("comp", F.col("root").alias("to"), "w")
        pair = ends.where("mutual").select("comp", F.least("comp", "to").alias("to"), F.when(F.col("size") + F.col("to_size") >= min_size, F.col("w")).alias("w"))
        move = durable(hung.union(pair))
        comps = durable(comps.join(move, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"), "n", F.coalesce("h", "w").alias("h")))
        step = lambda x: edges.join(move.select(F.col("comp").alias(x), F.col("to").alias(f"to_{x}")), x, "left")
        edges = step("a").select("u", "v", "w", "b", F.coalesce("to_a", "a").alias("a"))
        edges = edges.join(move.select(F.col("comp").alias("b"), F.col("to").alias("to_b")), "b", "left").select("u", "v", "w", "a", F.coalesce("to_b", "b").alias("b")).where("a <> b")
    # large components never move, so a split's ends are leaves
    return comps.select("id", "n", "h", F.when(F.col("h").isNotNull(), F.col("comp")).alias("leaf")), splits.select("a", "b", "w")


def hierarchy(leaves: pd.DataFrame, splits: pd.DataFrame) -> pd.DataFrame:
    """Clusters (leaf, clusters, formed): of each leaf its own cluster and all above it, with the weights at which they form.

    leaves: leaf, formed; splits: a, b, w, at most one fewer than leaves. Splits of one weight count at once, and a leaf that
    only forms at that weight is no cluster of its own.
    """
    root = {int(x): int(x) for x in leaves["leaf"]}
    formed = dict(zip(map(int, leaves["leaf"]), leaves["formed"], strict=True))
    top, above, since = {x: x for x in root}, {}, dict(formed)  # top: the current cluster of a component

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    fresh = -1
    for w, group in splits.sort_values("w").groupby("w", sort=True):
        before: dict[int, set[int]] = {}
        for a, b in zip(map(int, group["a"]), map(int, group["b"]), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[b] = a
                before[a] = before.pop(a, {top[a]}) | before.pop(b, {top[b]})
        for x, parts in before.items():
            held = {c for c in parts if since[c] < w}
            if len(held) == 1:
                kept = held.pop()
                above |= {c: kept for c in parts if c != kept}
                top[x] = kept
            else:
                above |= {c: fresh for c in parts}
                since[fresh], top[x], fresh = w, fresh, fresh - 1
    rows = []
    for leaf in leaves["leaf"]:
        c, chain = int(leaf), [int(leaf)]
        while c in above:
            c = above[c]
            chain.append(c)
        at, ids = [], []
        for c in chain:  # what forms with its parent, or after it, is none
            while at and since[c] <= at[-1]:
                at.pop()
                ids.pop()
            at.append(since[c])
            ids.append(c)
        rows.append((int(leaf), ids, at))
    return pd.DataFrame(rows, columns=["leaf", "clusters", "formed"])


def selected(rows: pd.DataFrame, method: str = "eom", epsilon: float = 0.0) -> pd.DataFrame:
    """(cluster, label): each cluster under a chosen one, with its number in order of the chosen clusters' least ids.

    rows: cluster, parent, formed, n, least and inverse, of the points that leave the cluster itself: their number, least id
    and sum of inverse weights. The root is never chosen.
    """
    inv = lambda w: 1 / max(w, LEAST_WEIGHT)
    parent = {int(c): None if pd.isna(p) else int(p) for c, p in zip(rows["cluster"], rows["parent"], strict=True)}
    get = lambda name: dict(zip(map(int, rows["cluster"]), rows[name], strict=True))
    formed, n, least, inverse = (get(c) for c in ("formed", "n", "least", "inverse"))
    kids: dict[int, list[int]] = {c: [] for c in parent}
    for c, p in parent.items():
        if p is not None:
            kids[p].append(c)
    rising = sorted(parent, key=lambda c: (formed[c], c))  # children first
    size, low, worth, best, chosen = {}, {}, {}, {}, set()
    for c in rising:
        size[c] = n[c] + sum(size[k] for k in kids[c])
        low[c] = min([least[c] if n[c] else float("inf"), *(low[k] for k in kids[c])])
        born = 0.0 if parent[c] is None else inv(formed[parent[c]])
        worth[c] = inverse[c] - n[c] * born + sum(size[k] for k in kids[c]) * (inv(formed[c]) - born)
        below = sum(best[k] for k in kids[c])
        if parent[c] is not None and (method == "leaf" and not kids[c] or method == "eom" and not (kids[c] and below > worth[c])):
            chosen.add(c)
        best[c] = max(worth[c], below) if kids[c] else worth[c]
    falling = rising[::-1]

    def under(some: set[int]) -> dict[int, int]:
        """Each cluster's topmost cluster of `some`, itself or above it."""
        out: dict[int, int] = {}
        for c in falling:
            if parent[c] in out:
                out[c] = out[parent[c]]
            elif c in some:
                out[c] = c
        return out

    if epsilon > 0:
        lifted = set()
        for c in set(under(chosen).values()):
            while formed[parent[c]] < epsilon and parent[parent[c]] is not None:
                c = parent[c]
            lifted.add(c)
        chosen = lifted
    over = under(chosen)
    number = {c: i for i, c in enumerate(sorted(set(over.values()), key=lambda c: low[c]))}
    return pd.DataFrame({"cluster": list(over), "label": [number[c] for c in over.values()]}).astype({"cluster": "int64", "label": "int32"})


def labelled(points: DataFrame, members: DataFrame, splits: DataFrame, min_size: int, method: str, epsilon: float) -> DataFrame:
    """(id, label) of all members (id, node). points: id, n, h, leaf of nodes."""
    inside = durable(points.where("leaf is not null"))
    leaves = inside.groupBy("leaf").agg(F.min("h").alias("formed"))
    both = leaves.select("leaf", "formed", F.col("leaf").alias("b"), F.lit(False).alias("split")).union(splits.select("a", "w", "b", F.lit(True)))

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        return hierarchy(rows[~rows["split"]], rows[rows["split"]].rename(columns={"leaf": "a", "formed": "w"}))

    chains = durable(both.groupBy().applyInPandas(order, "leaf long, clusters array<long>, formed array<double>"))
    place = F.greatest(F.size(F.filter("formed", lambda w: w <= F.col("h"))), F.lit(1))
    spots = members.join(inside.select(F.col("id").alias("node"), "h", "leaf"), "node").join(chains, "leaf").select("id", "h", F.element_at("clusters", place).alias("cluster"))
    spots = durable(spots)
    links = chains.select(F.explode(F.arrays_zip("clusters", F.concat(F.slice("clusters", 2, F.size("clusters")), F.array(F.lit(None).cast("long"))).alias("parent"), "formed")).alias("c"))
    links = links.select(F.col("c.clusters").alias("cluster"), F.col("c.parent").alias("parent"), F.col("c.formed").alias("formed")).distinct()
    own = spots.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.sum(1 / F.greatest("h", F.lit(LEAST_WEIGHT))).alias("inverse"))
    table = links.join(own, "cluster", "left").fillna(0, ["n"]).fillna(0.0, ["inverse"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        return selected(rows, method, epsilon)

    label = table.groupBy().applyInPandas(choose, "cluster long, label int")
    return spots.join(label, "cluster", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def block_tree(block: pd.DataFrame, min_samples: int) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Core distances of one block's nodes (feat, n), and its spanning tree by nearest additions."""
    feat, n = matrix(block["feat"]), block["n"].to_numpy()
    core = np.zeros(len(feat))
    for part, d in distances(feat, feat):
        order = np.argsort(d, axis=1)
        enough = np.cumsum(n[order], axis=1) >= min_samples
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(feat) - 1)
        core[part] = np.take_along_axis(d, order, 1)[np.arange(len(d)), last]
    left, low, near, edges, at = np.ones(len(feat), bool), np.full(len(feat), np.inf), np.zeros(len(feat), int), [], 0
    for _ in range(len(feat) - 1):
        left[at] = False
        w = np.maximum(np.maximum(np.sqrt(((feat - feat[at]) ** 2).sum(axis=1)), core[at]), core)
        nearer = left & (w < low)
        low[nearer], near[nearer] = w[nearer], at
        at = int(np.where(left, low, np.inf).argmin())
        edges.append((int(near[at]), at, float(low[at])))
    return core, edges


def block_departures(block: pd.DataFrame, min_samples: int, min_size: int) -> pd.DataFrame:
    """As `departures`, of the nodes (id, feat, n) of one block: rows with id, n, h, leaf, and rows with a, b, w."""
    core, edges = block_tree(block, min_samples)
    ids, n = block["id"].tolist(), block["n"].tolist()
    root, size, inner = list(range(len(ids))), list(n), [[i] for i in range(len(ids))]
    h: list[float | None] = [float(core[i]) if n[i] >= min_size else None for i in range(len(ids))]
    leaf = [ids[i] if n[i] >= min_size else None for i in range(len(ids))]
    splits = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v, w in sorted(edges, key=lambda e: (e[2], *sorted((ids[e[0]], ids[e[1]])))):
        a, b = find(u), find(v)
        if leaf[u] is not None and leaf[v] is not None:
            splits.append((leaf[u], leaf[v], w))
        elif leaf[u] is not None or leaf[v] is not None or size[a] + size[b] >= min_size:
            small = inner[a] * (leaf[u] is None) + inner[b] * (leaf[v] is None)
            to = leaf[u] if leaf[u] is not None else leaf[v] if leaf[v] is not None else min(ids[i] for i in small)
            for i in small:
                h[i], leaf[i] = w, to
        root[b], size[a], inner[a] = a, size[a] + size[b], inner[a] + inner[b] if leaf[u] is None else []
    nodes = pd.DataFrame({"id": ids, "n": n, "h": h, "leaf": pd.array(leaf, "Int64")})
    return pd.concat([nodes, pd.DataFrame(splits, columns=["a", "b", "w"]).astype({"a": "Int64", "b": "Int64", "w": "float64"})]).astype({c: "Int64" for c in ("id", "n", "leaf", "a", "b")})


def hdbscan(cells: DataFrame, min_cluster_size: int = 32, min_samples: int = 16, method: str = "eom", epsilon: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(id, label) of cells (id, feat), -1 for noise and for rows without finite features; a point is its own first neighbour.

    method: `eom`, the clusters of most excess of mass, or `leaf`. Chosen clusters that form below epsilon are lifted. The
    root is never a cluster, so data that never part are all noise.
    """
    if method not in ("eom", "leaf"):
        raise ValueError(f"unknown method {method!r}")
    nodes, members = nodes_of(cells)
    if nodes.count() <= block:

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            return block_departures(rows, min_samples, min_cluster_size)

        found = durable(nodes.groupBy().applyInPandas(whole, "id long, n long, h double, leaf long, a long, b long, w double"))
        points, splits = found.where("id is not null").select("id", "n", "h", "leaf"), found.where("a is not null").select("a", "b", "w")
    else:
        dealt_out = dealt(nodes)
        near = durable(feature_neighbours(dealt_out, max(min_samples, 2)))
        core = durable(core_distances(near, min_samples))
        tree = durable(spanning_tree(dealt_out, near, core))
        points, splits = departures(nodes.select("id", "n").join(core, "id"), tree, min_cluster_size)
    label = labelled(points, members, splits, min_cluster_size, method, epsilon)
    return cells.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def augmented(cells: DataFrame, with_position: float = 0.0, with_colour: float = 0.0) -> DataFrame:
    """cells (id, feat, and x, y, z or colour) with weighted colours and positions before the features."""
    feat = F.col("feat")
    if with_position > 0:
        feat = F.concat(F.array(*[F.col(c) * with_position for c in "xyz"]), feat)
    if with_colour > 0:
        # Fixed value: the constant of the zeroth spherical harmonic.
        feat = F.concat(F.transform("colour", lambda c: (c * 0.28209479177387814 + 0.5) * with_colour), feat)
    return cells.withColumn("feat", feat)


def hdbscan_sampled(cells: DataFrame, sample: int = 60_000, seed: int = 0, **options) -> DataFrame:
    """(id, label) of all cells by the nearest centroid of the clusters of a seeded sample; -1 where the sample has none."""
    some = durable(cells.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("id", "feat"))
    held = some.join(hdbscan(some, **options).where("label >= 0"), "id").select("label", F.posexplode("feat").alias("i", "x"))
    rows = held.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).orderBy("label").collect()
    centre, label = np.array([[e.x for e in r.c] for r in rows]), np.array([r.label for r in rows], np.int32)  # at most one for min_cluster_size rows of the sample

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.full(len(batch), -1, np.int32)
            if len(label) and len(batch):
                for part, d in distances(matrix(batch["feat"]), centre):
                    out[part] = label[d.argmin(axis=1)]
            yield pd.DataFrame({"id": batch["id"], "label": out})

    return cells.select("id", "feat").mapInPandas(assign, "id long, label int")
