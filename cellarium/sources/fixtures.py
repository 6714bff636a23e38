"""Relations of the domain, derived from the driver's tables, in SQL that Spark and the oracle engine share.

Upper-case words with arguments are macros: they are written out for either engine by `dialect`.
"""

from __future__ import annotations

import re

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
F16 = "ARR(" + ", ".join(f"CAST(EL(embedding, {i}) AS DOUBLE)" for i in range(4, 20)) + ")"
XYZ = "CAST(EL(embedding, 1) AS DOUBLE) AS x, CAST(EL(embedding, 2) AS DOUBLE) AS y, CAST(EL(embedding, 3) AS DOUBLE) AS z"

FIXTURES = {
    "cells": f"SELECT vec_id AS cell_id, {XYZ}, {F16} AS feat, 40 * abs(CAST(EL(embedding, 20) AS DOUBLE)) AS density FROM {{embeddings}} WHERE vec_id % 2 = 0",
    "probes": f"SELECT vec_id AS probe_id, {XYZ} FROM {{embeddings}} WHERE vec_id % 2 = 1",
    "cell_labels": "SELECT vec_id AS cell_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM {embeddings} WHERE vec_id % 2 = 0",
    "neighbours": "SELECT a, b, d FROM (SELECT p.cell_id AS a, q.cell_id AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d, row_number() OVER (PARTITION BY p.cell_id ORDER BY pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2), q.cell_id) AS k FROM cells p JOIN cells q ON p.cell_id <> q.cell_id) n WHERE k <= 6",
    "edges": "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM neighbours",
    "edge_d": "SELECT u, v, 1 - DOT(p.feat, q.feat) / sqrt(DOT(p.feat, p.feat) * DOT(q.feat, q.feat)) AS d, least(p.density, q.density) AS solid FROM edges JOIN cells p ON p.cell_id = u JOIN cells q ON q.cell_id = v",
    "segments": "SELECT user_id AS ray_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step, event_type AS label, CAST(value AS DOUBLE) / 1000.0 AS od FROM {events}",
    "lit": "SELECT ray_id, step, label, od, exp(-coalesce(sum(od) OVER (PARTITION BY ray_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t FROM segments",
    "hits": "SELECT ray_id, step, label, od, t, t * (1 - exp(-od)) AS w, t * exp(-od) AS t_next FROM lit WHERE t > 1e-3 AND step <= 1024",
    "cell_masks": "SELECT l_orderkey % 200 AS view_id, l_partkey % 100 AS cell_id, max(l_returnflag) AS mask FROM {lineitem} GROUP BY l_orderkey % 200, l_partkey % 100",
    "mask_pixels": "SELECT DISTINCT o_orderkey % 5 AS frame_idx, o_custkey % 12 AS obj_id, CAST(floor(o_orderkey / 5) AS BIGINT) % 400 AS pixel FROM {orders}",
    "vertices": "SELECT o_orderkey AS vertex_id, CASE WHEN o_custkey % 20 >= 17 THEN NULL ELSE o_custkey % 20 END AS gt_id, CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey + 1) % 20 ELSE o_custkey % 20 END AS pred_id FROM {orders}",
    "pixels": f"SELECT vec_id AS pixel_id, vec_id % 8 AS view_id, label AS mask_id, {F16} AS feat FROM {{embeddings}}",
    "pixel_dims": "SELECT pixel_id, view_id, mask_id, i, EL(feat, i) AS f FROM pixels JOIN dims ON true",
    "cell_dims": "SELECT c.cell_id, label, i, EL(feat, i) AS f FROM cells c JOIN cell_labels l ON c.cell_id = l.cell_id JOIN dims ON true",
    "dims": "SELECT CAST(i AS INT) AS i FROM SEQ(1, 16)",
    "results": "SELECT CAST(year(o_orderdate) AS INT) AS scene, o_orderpriority AS config, avg(o_totalprice) AS ap FROM {orders} GROUP BY CAST(year(o_orderdate) AS INT), o_orderpriority",
    "tets": "SELECT DISTINCT l_orderkey % 40 AS t, ARR(l_partkey % 30, 30 + l_suppkey % 7, 40 + l_orderkey % 9, 60 + l_linenumber) AS vs FROM {lineitem}",
    "quads": "SELECT CAST(row_number() OVER (ORDER BY EL(vs, 1), EL(vs, 2), EL(vs, 3), EL(vs, 4)) AS BIGINT) AS tet_id, EL(vs, 1) AS v1, EL(vs, 2) AS v2, EL(vs, 3) AS v3, CAST(EL(vs, 4) AS BIGINT) AS v4 FROM (SELECT DISTINCT vs FROM tets) s",
    "rectangles": "SELECT CAST(floor(c_custkey / 60) AS INT) AS frame_idx, CAST(c_nationkey AS INT) AS obj_id, CAST(c_custkey * 37 % 80 AS INT) AS x0, CAST(c_custkey * 53 % 60 AS INT) AS y0, CAST(6 + c_custkey % 17 AS INT) AS w, CAST(5 + c_custkey % 13 AS INT) AS h FROM {customer}",
    "blobs": "SELECT DISTINCT frame_idx, obj_id, y0 + r.i AS row, x0 + c.i AS col FROM rectangles JOIN (SELECT CAST(i AS INT) AS i FROM SEQ(0, 16)) r ON r.i < h AND y0 + r.i < 72 JOIN (SELECT CAST(i AS INT) AS i FROM SEQ(0, 22)) c ON c.i < w AND x0 + c.i < 96 + 8 * (frame_idx % 3)",
    "found_blobs": "SELECT DISTINCT frame_idx, obj_id, y0 + r.i AS row, x0 + c.i AS col FROM rectangles JOIN (SELECT CAST(i AS INT) AS i FROM SEQ(1, 15)) r ON r.i < h - 1 AND y0 + r.i < 72 JOIN (SELECT CAST(i AS INT) AS i FROM SEQ(1, 21)) c ON c.i < w - 1 - x0 % 2 AND x0 + c.i < 96 + 8 * (frame_idx % 3)",
    "mask_sizes": "SELECT frame_idx, obj_id, count(*) AS n FROM mask_pixels GROUP BY frame_idx, obj_id",
    "mask_pairs": "SELECT a.frame_idx, a.obj_id AS a, b.obj_id AS b, count(*) AS both_n FROM mask_pixels a JOIN mask_pixels b ON a.frame_idx = b.frame_idx AND a.pixel = b.pixel AND a.obj_id < b.obj_id GROUP BY a.frame_idx, a.obj_id, b.obj_id",
    "ious": "SELECT p.frame_idx, p.a, p.b, both_n / CAST(x.n + y.n - both_n AS DOUBLE) AS iou FROM mask_pairs p JOIN mask_sizes x ON x.frame_idx = p.frame_idx AND x.obj_id = p.a JOIN mask_sizes y ON y.frame_idx = p.frame_idx AND y.obj_id = p.b",
    "votes": "SELECT u, v, sum(CASE WHEN a.mask = b.mask THEN 1 ELSE 0 END) AS agree, sum(CASE WHEN a.mask <> b.mask THEN 1 ELSE 0 END) AS disagree FROM edges JOIN cell_masks a ON a.cell_id = u % 100 JOIN cell_masks b ON b.cell_id = v % 100 AND a.view_id = b.view_id GROUP BY u, v",
    "centroid_dims": "SELECT label, i, avg(f) AS c FROM cell_dims WHERE label >= 0 GROUP BY label, i",
    "nearest_label": "SELECT cell_id, label, dist FROM (SELECT d.cell_id, c.label, sqrt(sum(pow(f - c, 2))) AS dist, row_number() OVER (PARTITION BY d.cell_id ORDER BY round(sqrt(sum(pow(f - c, 2))), 9), c.label) AS k FROM cell_dims d JOIN centroid_dims c ON d.i = c.i GROUP BY d.cell_id, c.label) s WHERE k = 1",
}

#: What Spark reads in place of a fixture, with the same rows: votes of an edge depend on its cells' classes alone, so they are counted
#: for each pair of classes that has an edge, at most 10,000, and handed to the edges.
PLANNED = {
    "votes": "SELECT u, v, agree, disagree FROM edges JOIN (SELECT a.cell_id AS cu, b.cell_id AS cv, sum(CASE WHEN a.mask = b.mask THEN 1 ELSE 0 END) AS agree, sum(CASE WHEN a.mask <> b.mask THEN 1 ELSE 0 END) AS disagree FROM cell_masks a JOIN cell_masks b ON a.view_id = b.view_id GROUP BY a.cell_id, b.cell_id) c ON cu = u % 100 AND cv = v % 100",
}


def _macro(sql: str, name: str, make) -> str:
    """Writes out each NAME(args) from the innermost on; arguments may hold parentheses."""
    at = 0
    while (m := re.search(rf"\b{name}\(", sql[at:])) is not None:
        start = at + m.start()
        i = at + m.end()
        depth, args, last = 1, [], i
        while depth:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            if (c == "," and depth == 1) or depth == 0:
                args.append(sql[last:i].strip())
                last = i + 1
            i += 1
        new = make(*args)
        sql = sql[:start] + new + sql[i:]
        at = start
    return sql


SPARK = {
    "ARR": lambda *a: f"array({', '.join(a)})", "EL": lambda a, i: f"element_at({a}, {i})", "SEQ": lambda a, b: f"(SELECT explode(sequence({a}, {b})) AS i) seq",
    "DOT": lambda a, b: f"aggregate(zip_with({a}, {b}, (p_, q_) -> p_ * q_), CAST(0 AS DOUBLE), (s_, x_) -> s_ + x_)", "QUANTILE": lambda x, p: f"percentile({x}, {p})",
    "UNROLL": lambda a: f"explode({a})", "GLUE": lambda x, o: f"listagg({x}, ',') WITHIN GROUP (ORDER BY {o})", "SHR": lambda a, b: f"shiftrightunsigned({a}, {b})", "XOR": lambda a, b: f"({a} ^ {b})",
    "DECIMALS": lambda x: f"format_number({x}, 2)", "EPOCH": lambda x: f"unix_micros(CAST({x} AS TIMESTAMP))", "MATCH": lambda s, p: f"regexp_extract({s}, {p}, 1)",
}
DUCK = {
    "ARR": lambda *a: f"[{', '.join(a)}]", "EL": lambda a, i: f"list_extract({a}, {i})", "SEQ": lambda a, b: f"(SELECT unnest(range({a}, {b} + 1)) AS i) seq",
    "DOT": lambda a, b: f"list_dot_product({a}, {b})", "QUANTILE": lambda x, p: f"quantile_cont({x}, {p})", "UNROLL": lambda a: f"unnest({a})",
    "GLUE": lambda x, o: f"string_agg({x}, ',' ORDER BY {o})", "SHR": lambda a, b: f"({a} >> {b})", "XOR": lambda a, b: f"xor({a}, {b})", "DECIMALS": lambda x: f"format('{{:,.2f}}', {x})", "EPOCH": lambda x: f"epoch_us({x})",
    "MATCH": lambda s, p: f"regexp_extract({s}, {p}, 1)",
}


def dialect(sql: str, macros: dict) -> str:
    for name, make in macros.items():
        sql = _macro(sql, name, make)
    # both engines read 0.5 as a decimal number; here all such numbers are doubles
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"CAST(\1 AS DOUBLE)", sql)


def with_fixtures(sql: str, built: tuple[str, ...] = (), planned: dict[str, str] | None = None) -> str:
    """The query with the fixtures it uses as common table expressions, in order of need; those in `built` are read as tables, and `planned` has other texts."""
    texts = FIXTURES | (planned or {}) | {n: f"SELECT * FROM {{{n}}}" for n in built}
    order: list[str] = []

    def need(text: str) -> None:
        for name in FIXTURES:
            if name not in order and re.search(rf"\b{name}\b", re.sub(r"\{\w+\}", "", text)) and name not in need.open:
                need.open.append(name)
                need(texts[name])
                order.append(name)

    need.open = []
    need(sql)
    head = ", ".join(f"{n} AS ({texts[n]})" for n in order)
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if own:
        return f"WITH {own[1] or ''}{head}{', ' if head else ''}{sql[own.end():]}"
    return f"WITH {head} {sql}" if head else sql


def tables(spark, sf_dir: str, sql: str) -> dict:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}


_kept = None


def neighbours(spark, sf_dir: str):
    """The neighbour graph by the grid join, kept as a table in the shared folder for as long as the folder's cells stay the same."""
    global _kept
    from cellarium.operators import nearest
    from cellarium.sources.versions import Kept

    _kept = _kept or Kept()
    cells = run(spark, sf_dir, "SELECT cell_id AS id, x, y, z FROM cells")
    return _kept.get((spark.sparkContext.applicationId, sf_dir), cells, lambda: nearest.neighbours(cells).select("a", "b", "d"))


def run(spark, sf_dir: str, sql: str):
    """The query in Spark; {table} stands for a table of sf_dir."""
    text = dialect(with_fixtures(sql, ("neighbours",), PLANNED), SPARK)
    more = {"neighbours": neighbours(spark, sf_dir)} if "{neighbours}" in text else {}
    return spark.sql(text, **tables(spark, sf_dir, text), **more)


def oracle(sql: str) -> str:
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", dialect(with_fixtures(sql), DUCK))


def fixture(spark, sf_dir: str, name: str):
    return run(spark, sf_dir, f"SELECT * FROM {name}")
