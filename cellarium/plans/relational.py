"""Queries that both engines express: name -> (operator ids, SQL over the fixtures)."""

SQL: dict[str, tuple[str, str]] = {
    # rays: compositing, readouts, depth
    "composite_argmax_label": ("W1 W2 C9", "SELECT ray_id, label, w, alpha FROM (SELECT ray_id, label, round(w, 6) AS w, round(1 - exp(-sum(od) OVER (PARTITION BY ray_id)), 6) AS alpha, row_number() OVER (PARTITION BY ray_id ORDER BY round(w, 9) DESC, label) AS k FROM (SELECT ray_id, label, sum(w) AS w, sum(od) AS od FROM hits GROUP BY ray_id, label) s) r WHERE k = 1 AND w > 1e-3"),
    "composite_alpha_depth": ("C2 W3 C12", "SELECT r.ray_id, q, alpha, step FROM (SELECT ray_id, round(1 - exp(-sum(od)), 6) AS alpha FROM hits GROUP BY ray_id) r JOIN (SELECT CAST(0.8 AS DOUBLE) AS q UNION ALL SELECT CAST(0.5 AS DOUBLE) UNION ALL SELECT CAST(0.2 AS DOUBLE)) qs ON true LEFT JOIN (SELECT ray_id AS rid, qq, min(step) AS step FROM hits JOIN (SELECT CAST(0.8 AS DOUBLE) AS qq UNION ALL SELECT CAST(0.5 AS DOUBLE) UNION ALL SELECT CAST(0.2 AS DOUBLE)) q2 ON t_next < qq GROUP BY ray_id, qq) d ON rid = r.ray_id AND qq = q"),
    "depth_quantile": ("W3 C4", "SELECT ray_id, round(min(step) - 1 + min_by(ln(t / 0.5) / od, step), 6) AS depth FROM hits WHERE t_next < 0.5 AND od > 0 GROUP BY ray_id"),
    "silhouette_labels": ("C10", "SELECT ray_id, label, round(sum(w), 6) AS w FROM hits GROUP BY ray_id, label HAVING sum(w) > 0.2"),
    "contribution_by_label": ("A13", "SELECT label, round(sum(w), 5) AS contribution, round(sum(w * abs(w - 0.5)), 5) AS error, count(*) AS n FROM hits GROUP BY label"),
    "max_contribution": ("A14", "SELECT label, round(max(w), 6) AS w FROM (SELECT label, ray_id % 10 AS view_id, sum(w) AS w FROM hits GROUP BY label, ray_id % 10) s GROUP BY label"),
    "feature_variance_per_ray": ("A23 C2", "SELECT ray_id, round(avg(v - f * f), 6) AS var, round(avg(pow(v - f * f, 2)), 6) AS loss FROM (SELECT ray_id, i, sum(w * EL(feat, i)) AS f, sum(w * pow(EL(feat, i), 2)) AS v FROM hits JOIN (SELECT count(*) AS n_cells FROM cells) c ON true JOIN cells ON cell_id = 2 * ((ray_id * 7 + step) % n_cells) JOIN dims ON true GROUP BY ray_id, i) s GROUP BY ray_id"),
    "composited_centroid_label": ("C11 J5", "SELECT ray_id, label FROM (SELECT r.ray_id, c.label, row_number() OVER (PARTITION BY r.ray_id ORDER BY round(sum(pow(f - c, 2)), 9), c.label) AS k FROM (SELECT ray_id, i, sum(w * EL(feat, i)) AS f FROM hits JOIN (SELECT count(*) AS n_cells FROM cells) c ON true JOIN cells ON cell_id = 2 * ((ray_id * 7 + step) % n_cells) JOIN dims ON true GROUP BY ray_id, i) r JOIN centroid_dims c ON r.i = c.i GROUP BY r.ray_id, c.label) s WHERE k = 1"),
    "packed_rgba": ("C5 F16 C4 P16", "SELECT ray_id, CAST(r AS BIGINT) + 256 * CAST(g AS BIGINT) + 65536 * CAST(b AS BIGINT) + 16777216 * CAST(a AS BIGINT) AS rgba FROM (SELECT ray_id, floor(255 * least(1, sum(w * 0.25))) AS r, floor(255 * least(1, sum(w * 0.5))) AS g, floor(255 * least(1, sum(w * 0.75))) AS b, floor(255 * round(1 - exp(-sum(od)), 9)) AS a FROM hits GROUP BY ray_id) s"),
    "intersection_counts": ("C4 W2", "SELECT ray_id, count(*) AS n FROM hits GROUP BY ray_id"),
    "psnr_per_view": ("A22", "SELECT view_id, round(avg(psnr), 6) AS psnr FROM (SELECT view_id, i, 20 * log10(1 / sqrt(avg(pow(f - 0.1, 2)))) AS psnr FROM pixel_dims WHERE i <= 3 GROUP BY view_id, i) s GROUP BY view_id"),
    "photometric_loss": ("A24", "SELECT round(avg(CASE WHEN abs(f) < 1 THEN 0.5 * f * f ELSE abs(f) - 0.5 END), 8) AS colour, round(avg(CASE WHEN f > 0 THEN pow(f, 2) ELSE 0 END), 8) AS masked FROM pixel_dims"),
    "pixel_rays": ("S2 S4 C7 O12", "SELECT px, py, round((px + 0.5 - 10) / 24, 6) AS dx, round((py + 0.5 - 8) / 24, 6) AS dy FROM (SELECT CAST(i AS INT) AS px FROM SEQ(0, 19)) a JOIN (SELECT CAST(i AS INT) AS py FROM SEQ(0, 15)) b ON true"),
    # cells: predicates and projections
    "density_activation": ("P2 F1", "SELECT cell_id, round(CASE WHEN 10 * raw > 20 THEN raw ELSE ln(1 + exp(10 * raw)) / 10 END, 6) AS sigma FROM (SELECT cell_id, density / 4 - 1 AS raw FROM cells) s"),
    "solid_cells": ("P3 P4", "SELECT c.cell_id, label FROM cells c JOIN cell_labels l ON c.cell_id = l.cell_id JOIN (SELECT max(density) AS m FROM (SELECT density, row_number() OVER (ORDER BY density, cell_id) AS k, count(*) OVER () AS n FROM cells WHERE density > 1e-3) r WHERE k <= floor((n + 1) / 2)) med ON density > m WHERE label = 3"),
    "guarded_attributes": ("P6 P15 P7", "SELECT c.cell_id, round(CASE WHEN density > 1e-6 THEN EL(feat, 1) ELSE 0 END, 6) AS dc, round(0.5 + 0.28209479177387814 * EL(feat, 2), 6) AS rgb, round(density, 6) AS density FROM cells c"),
    "prune_candidates": ("P9", "SELECT c.cell_id FROM cells c JOIN (SELECT a, avg(d) / 2 AS radius FROM neighbours GROUP BY a) r ON r.a = c.cell_id LEFT JOIN (SELECT DISTINCT n.a FROM neighbours n JOIN cells q ON q.cell_id = n.b WHERE q.density > 8) h ON h.a = c.cell_id WHERE c.density <= 8 AND h.a IS NULL AND radius < 0.1"),
    "label_coverage": ("P5 P10", "SELECT cell_id % 4 AS level, round(avg(CASE WHEN label >= 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM cell_labels GROUP BY cell_id % 4"),
    "duplicate_sites": ("P11", "SELECT round(x, 2) + 0.0 AS rx, round(y, 2) + 0.0 AS ry, count(*) AS n FROM cells GROUP BY round(x, 2) + 0.0, round(y, 2) + 0.0 HAVING count(*) > 1"),
    "mask_quality_filter": ("P14", "SELECT frame_idx, obj_id, obj_id % 3 AS level FROM mask_sizes WHERE n / 400.0 > 0.03 AND n / 300.0 >= 0.05"),
    "morton_code": ("F3 O1", "SELECT cell_id, CAST(sum((SHR(qx, b) & 1) * pow(2, 3 * b) + (SHR(qy, b) & 1) * pow(2, 3 * b + 1) + (SHR(qz, b) & 1) * pow(2, 3 * b + 2)) AS BIGINT) AS code FROM (SELECT cell_id, CAST(floor((x + 1) * 511) AS INT) AS qx, CAST(floor((y + 1) * 511) AS INT) AS qy, CAST(floor((z + 1) * 511) AS INT) AS qz FROM cells) q JOIN (SELECT CAST(i AS INT) AS b FROM SEQ(0, 9)) bits ON true GROUP BY cell_id"),
    "aabb_levels": ("A31 F6", "SELECT level, CAST(floor((r - 1) / pow(2, level)) AS BIGINT) AS node, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1 FROM (SELECT x, y, row_number() OVER (ORDER BY cell_id) AS r FROM cells) c JOIN (SELECT CAST(i AS INT) AS level FROM SEQ(1, 8)) l ON true GROUP BY level, CAST(floor((r - 1) / pow(2, level)) AS BIGINT)"),
    "up_direction_moments": ("A32 A33", "SELECT round(sum(x * x), 6) AS xx, round(sum(x * y), 6) AS xy, round(sum(x * z), 6) AS xz, round(sum(y * y), 6) AS yy, round(sum(y * z), 6) AS yz, round(sum(z * z), 6) AS zz FROM cells"),
    "projection_percentiles": ("A20 P8", "SELECT i, round(QUANTILE(f, 0.02), 6) AS lo, round(QUANTILE(f, 0.98), 6) AS hi FROM cell_dims GROUP BY i"),
    # graph
    "edge_dissimilarity_cosine": ("J1 J2 F9", "SELECT u, v, round(d, 6) AS d FROM edge_d"),
    "edge_dissimilarity_l2": ("J2", "SELECT u, v, round(sqrt(greatest(0, DOT(p.feat, p.feat) + DOT(q.feat, q.feat) - 2 * DOT(p.feat, q.feat))), 6) AS d FROM edges JOIN cells p ON p.cell_id = u JOIN cells q ON q.cell_id = v"),
    "edge_occupancy": ("J3", "SELECT u, v, round(solid, 6) AS solid FROM edge_d"),
    "cell_extent_opacity": ("A9 F2", "SELECT cell_id, round(extent, 6) AS extent, round(1 - exp(-density * extent), 6) AS opacity FROM (SELECT c.cell_id, c.density, 0.5 * avg(sqrt(pow(c.x - q.x, 2) + pow(c.y - q.y, 2) + pow(c.z - q.z, 2))) AS extent FROM cells c JOIN (SELECT u AS s, v AS e FROM edges UNION ALL SELECT v, u FROM edges) n ON n.s = c.cell_id JOIN cells q ON q.cell_id = n.e GROUP BY c.cell_id, c.density) r"),
    "occupancy_losses": ("A11 A12", "SELECT round(avg(-(a * ln(a) + (1 - a) * ln(1 - a))), 6) AS entropy, round(avg(a * (1 - a)), 6) AS quadratic, round(avg(CASE WHEN a > 0.1 AND a < 0.9 THEN 1.0 ELSE 0.0 END), 6) AS undecided, round(avg(CASE WHEN a >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS solid FROM (SELECT least(1 - 1e-6, greatest(1e-6, 1 - exp(-density * 0.1))) AS a FROM cells) s"),
    "total_variation": ("A11", "SELECT round(sum(w * abs(pa - qa)) / greatest(sum(w), 1e-12), 6) AS tv FROM (SELECT pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS w, 1 - exp(-p.density * 0.1) AS pa, 1 - exp(-q.density * 0.1) AS qa FROM edges JOIN cells p ON p.cell_id = u JOIN cells q ON q.cell_id = v) s"),
    "cell_radius_farthest": ("A10", "SELECT a AS cell_id, round(avg(d) / 2, 6) AS radius, max_by(b, round(d, 9) - b * 1e-12) AS farthest FROM neighbours GROUP BY a"),
    "one_ring": ("J13", "SELECT DISTINCT cell_id FROM (SELECT cell_id FROM cell_labels WHERE label = 2 UNION ALL SELECT v FROM edges JOIN cell_labels ON cell_id = u WHERE label = 2 UNION ALL SELECT u FROM edges JOIN cell_labels ON cell_id = v WHERE label = 2) s"),
    "free_box_cells": ("G15 U3", "SELECT c.cell_id FROM cells c JOIN cell_labels l ON l.cell_id = c.cell_id JOIN (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM cells d JOIN cell_labels m ON m.cell_id = d.cell_id WHERE label = 2) b ON x BETWEEN x0 - 0.12 * (x1 - x0) AND x1 + 0.12 * (x1 - x0) AND y BETWEEN y0 - 0.12 * (y1 - y0) AND y1 + 0.12 * (y1 - y0) AND z BETWEEN z0 - 0.12 * (z1 - z0) AND z1 + 0.12 * (z1 - z0) WHERE label <> 2"),
    "tet_to_adjacency": ("G16 W6 W7", "SELECT a, count(*) AS degree, min(b) AS first_neighbour FROM (SELECT DISTINCT a, b FROM (SELECT v1 AS a, v2 AS b FROM quads UNION ALL SELECT v1, v3 FROM quads UNION ALL SELECT v1, v4 FROM quads UNION ALL SELECT v2, v3 FROM quads UNION ALL SELECT v2, v4 FROM quads UNION ALL SELECT v3, v4 FROM quads UNION ALL SELECT v2, v1 FROM quads UNION ALL SELECT v3, v1 FROM quads UNION ALL SELECT v4, v1 FROM quads UNION ALL SELECT v3, v2 FROM quads UNION ALL SELECT v4, v2 FROM quads UNION ALL SELECT v4, v3 FROM quads) s) e GROUP BY a"),
    "tet_faces": ("J15 U5 U6 D3", "SELECT f1, f2, f3, count(*) AS owners, min(tet_id) AS first_tet FROM (SELECT tet_id, v1 AS f1, v2 AS f2, v3 AS f3 FROM quads UNION ALL SELECT tet_id, v1, v2, v4 FROM quads UNION ALL SELECT tet_id, v1, v3, v4 FROM quads UNION ALL SELECT tet_id, v2, v3, v4 FROM quads) s GROUP BY f1, f2, f3"),
    "new_tets": ("J16 U5", "SELECT q.tet_id FROM quads q LEFT JOIN (SELECT v1, v2, v3, v4 FROM quads WHERE tet_id % 3 = 0) o ON q.v1 = o.v1 AND q.v2 = o.v2 AND q.v3 = o.v3 AND q.v4 = o.v4 WHERE o.v1 IS NULL"),
    "relabel_components": ("A5", "SELECT l.cell_id, CAST(coalesce(new_label, -1) AS INT) AS label FROM cell_labels l LEFT JOIN (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS new_label FROM (SELECT label FROM cell_labels WHERE label >= 0 GROUP BY label HAVING count(*) >= 22) k) r ON r.label = l.label"),
    "cluster_sizes": ("A28 A30", "SELECT max(n) AS largest, round(max(n) / sum(n), 6) AS share, round(QUANTILE(n, 0.5), 6) AS median_n FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM cell_labels WHERE label >= 0 GROUP BY label) s"),
    "cluster_centroids": ("A4 D13", "SELECT label, i, round(c, 6) AS c FROM centroid_dims"),
    "assign_nearest_centroid": ("J5", "SELECT cell_id, label, round(dist, 6) AS dist FROM nearest_label"),
    "fill_noise": ("J8", "SELECT l.cell_id, CASE WHEN l.label >= 0 THEN l.label ELSE n.label END AS label FROM cell_labels l JOIN nearest_label n ON n.cell_id = l.cell_id"),
    "nearest_visible_cell": ("J6 J7", "SELECT probe_id, cell_id FROM (SELECT probe_id, cell_id, row_number() OVER (PARTITION BY probe_id ORDER BY pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2), cell_id) AS k FROM probes p JOIN cells c ON density > 1e-3) s WHERE k = 1"),
    "start_cells": ("J9 C8", "WITH origins AS (SELECT DISTINCT round(x, 1) + 0.0 AS ox, round(y, 1) + 0.0 AS oy FROM probes) SELECT ox, oy, cell_id FROM (SELECT ox, oy, cell_id, row_number() OVER (PARTITION BY ox, oy ORDER BY pow(ox - x, 2) + pow(oy - y, 2) + z * z, cell_id) AS k FROM origins JOIN cells ON true) s WHERE k = 1"),
    "core_distances": ("J20 G13", "SELECT cell_id, round(d, 6) AS core FROM (SELECT p.cell_id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d, row_number() OVER (PARTITION BY p.cell_id ORDER BY pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2), q.cell_id) AS k FROM cells p JOIN cells q ON true) s WHERE k = 16"),
    # masks
    "mask_iou": ("A6 U2", "SELECT frame_idx, a, b, round(iou, 6) AS iou FROM ious"),
    "instance_ioa": ("A7", "SELECT m.frame_idx, obj_id, round(avg(CASE WHEN m.pixel % 20 < 10 THEN 1.0 ELSE 0.0 END), 6) AS ioa FROM mask_pixels m GROUP BY m.frame_idx, obj_id"),
    "proposal_anti_join": ("J11 T4", "SELECT s.frame_idx, s.obj_id FROM mask_sizes s LEFT JOIN (SELECT DISTINCT frame_idx, b FROM ious JOIN (SELECT QUANTILE(iou, 0.9) AS cut FROM ious) q ON iou >= cut) m ON m.frame_idx = s.frame_idx AND m.b = s.obj_id WHERE m.b IS NULL"),
    "void_share": ("A8 U4", "SELECT pred_id, round(avg(CASE WHEN gt_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS void_share, count(*) AS n FROM vertices GROUP BY pred_id"),
    "bounding_boxes": ("A29 F19", "SELECT frame_idx, obj_id, min(CAST(floor(pixel / 20) AS BIGINT)) AS r0, max(CAST(floor(pixel / 20) AS BIGINT)) + 1 AS r1, min(pixel % 20) AS c0, max(pixel % 20) + 1 AS c1 FROM mask_pixels GROUP BY frame_idx, obj_id"),
    "mask_union": ("U1", "SELECT frame_idx, count(DISTINCT pixel) AS n FROM mask_pixels WHERE obj_id IN (1, 2, 3) GROUP BY frame_idx"),
    "category_universe": ("U7", "SELECT DISTINCT obj_id FROM mask_pixels"),
    "rle_encode": ("W8 F10 K3", "SELECT frame_idx, obj_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS area, GLUE(concat(CAST(s AS STRING), ':', CAST(n AS STRING)), s) AS rle FROM (SELECT frame_idx, obj_id, min(pixel) + 1 AS s, count(*) AS n FROM (SELECT frame_idx, obj_id, pixel, pixel - row_number() OVER (PARTITION BY frame_idx, obj_id ORDER BY pixel) AS g FROM mask_pixels) i GROUP BY frame_idx, obj_id, g) r GROUP BY frame_idx, obj_id"),
    "paint_labels": ("F17 D10", "SELECT frame_idx, pixel, obj_id FROM (SELECT m.frame_idx, pixel, m.obj_id, row_number() OVER (PARTITION BY m.frame_idx, pixel ORDER BY n, m.obj_id) AS k FROM mask_pixels m JOIN mask_sizes s ON s.frame_idx = m.frame_idx AND s.obj_id = m.obj_id) p WHERE k = 1"),
    "erosion_band": ("W10 E3", "WITH rowsok AS (SELECT a.frame_idx, a.obj_id, a.pixel FROM mask_pixels a JOIN mask_pixels b ON a.frame_idx = b.frame_idx AND a.obj_id = b.obj_id AND floor(a.pixel / 20) = floor(b.pixel / 20) AND b.pixel BETWEEN a.pixel - 1 AND a.pixel + 1 GROUP BY a.frame_idx, a.obj_id, a.pixel HAVING count(*) = 3), core AS (SELECT a.frame_idx, a.obj_id, a.pixel FROM rowsok a JOIN rowsok b ON a.frame_idx = b.frame_idx AND a.obj_id = b.obj_id AND a.pixel % 20 = b.pixel % 20 AND b.pixel BETWEEN a.pixel - 20 AND a.pixel + 20 GROUP BY a.frame_idx, a.obj_id, a.pixel HAVING count(*) = 3) SELECT m.frame_idx, m.obj_id, count(*) - count(c.pixel) AS band FROM mask_pixels m LEFT JOIN core c ON c.frame_idx = m.frame_idx AND c.obj_id = m.obj_id AND c.pixel = m.pixel GROUP BY m.frame_idx, m.obj_id"),
    "dilation_area": ("W11", "SELECT frame_idx, obj_id, CAST(count(DISTINCT pixel + 20 * dr + dc) AS BIGINT) AS area FROM mask_pixels JOIN (SELECT CAST(i AS INT) AS dr FROM SEQ(-1, 1)) r ON floor(pixel / 20) + dr BETWEEN 0 AND 19 JOIN (SELECT CAST(i AS INT) AS dc FROM SEQ(-1, 1)) c ON pixel % 20 + dc BETWEEN 0 AND 19 GROUP BY frame_idx, obj_id"),
    "interior_point": ("F18 F21", "SELECT frame_idx, obj_id, min(pixel) AS pixel FROM (SELECT m.frame_idx, m.obj_id, m.pixel, rank() OVER (PARTITION BY m.frame_idx, m.obj_id ORDER BY min(pow(floor(m.pixel / 20) - floor(g.i / 20), 2) + pow(m.pixel % 20 - g.i % 20, 2)) DESC) AS k FROM mask_pixels m JOIN SEQ(0, 399) g ON true LEFT JOIN mask_pixels o ON o.frame_idx = m.frame_idx AND o.obj_id = m.obj_id AND o.pixel = g.i WHERE o.pixel IS NULL GROUP BY m.frame_idx, m.obj_id, m.pixel) s WHERE k = 1 GROUP BY frame_idx, obj_id".replace("SEQ(0, 399) g", "(SELECT i FROM SEQ(0, 399)) g")),
    "polygon_raster": ("S15", "WITH corners AS (SELECT CAST(1 AS INT) AS k, 2.0 AS x, 3.0 AS y, 15.5 AS x2, 4.5 AS y2 UNION ALL SELECT 2, 15.5, 4.5, 12.0, 16.0 UNION ALL SELECT 3, 12.0, 16.0, 2.0, 3.0) SELECT px, py FROM (SELECT CAST(i AS INT) AS px FROM SEQ(0, 19)) a JOIN (SELECT CAST(i AS INT) AS py FROM SEQ(0, 19)) b ON true JOIN corners c ON (y > py + 0.5) <> (y2 > py + 0.5) AND px + 0.5 < (x2 - x) * (py + 0.5 - y) / (y2 - y) + x GROUP BY px, py HAVING count(*) % 2 = 1"),
    # evaluation
    "pr_curve_interpolation": ("W5 O9 E2", "WITH preds AS (SELECT pred_id, count(*) AS n, max(CASE WHEN gt_id = pred_id THEN 1 ELSE 0 END) AS tp FROM vertices GROUP BY pred_id), g AS (SELECT count(DISTINCT gt_id) AS total FROM vertices), r AS (SELECT pred_id, tp, CAST(sum(tp) OVER (ORDER BY n DESC, pred_id) AS DOUBLE) AS cum, row_number() OVER (ORDER BY n DESC, pred_id) AS k FROM preds) SELECT pred_id, round(cum / total, 6) AS recall, round(max(cum / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS envelope FROM r JOIN g ON true"),
    "instance_overlap": ("A6 E1", "SELECT p.pred_id, p.gt_id, round(both_n / CAST(a.n + b.n - both_n AS DOUBLE), 6) AS iou FROM (SELECT pred_id, gt_id, count(*) AS both_n FROM vertices WHERE gt_id IS NOT NULL GROUP BY pred_id, gt_id) p JOIN (SELECT pred_id, count(*) AS n FROM vertices GROUP BY pred_id) a ON a.pred_id = p.pred_id JOIN (SELECT gt_id, count(*) AS n FROM vertices GROUP BY gt_id) b ON b.gt_id = p.gt_id"),
    "best_single_instance": ("O14", "SELECT gt_id, max_by(pred_id, both_n * 1000 - pred_id) AS best FROM (SELECT pred_id, gt_id, count(*) AS both_n FROM vertices WHERE gt_id IS NOT NULL GROUP BY pred_id, gt_id) s GROUP BY gt_id"),
    "tie_order_ranks": ("O11 F4", "SELECT trial, pred_id, CAST(row_number() OVER (PARTITION BY trial ORDER BY CASE WHEN trial = 0 THEN pred_id ELSE (pred_id * 7919 + trial * 104729) % 1009 END, pred_id) AS INT) AS place FROM (SELECT DISTINCT pred_id FROM vertices) p JOIN (SELECT CAST(i AS INT) AS trial FROM SEQ(0, 20)) t ON true"),
    "config_summary": ("A25", "SELECT config, round(avg(ap), 4) AS mean_ap, round(stddev_samp(ap), 4) AS sd, round(min(ap), 4) AS lo, round(max(ap), 4) AS hi FROM results GROUP BY config"),
    "paired_config_delta": ("J19 E7", "SELECT a.config AS a, b.config AS b, round(avg(a.ap - b.ap), 4) AS delta, CAST(sum(CASE WHEN a.ap > b.ap THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM results a JOIN results b ON a.scene = b.scene AND a.config < b.config GROUP BY a.config, b.config"),
    "complete_configs": ("A26", "SELECT config FROM results GROUP BY config HAVING count(DISTINCT scene) = (SELECT count(DISTINCT scene) FROM results)"),
    "two_level_mean": ("A27", "SELECT round(avg(m), 4) AS per_class, round(max(flat), 4) AS flat FROM (SELECT config, avg(ap) AS m FROM results GROUP BY config) s JOIN (SELECT avg(ap) AS flat FROM results) f ON true"),
    "official_rows": ("K7 F15", "SELECT vertex_id, coalesce(gt_id * 1000 + pred_id, 0) AS code, concat('pred_', CAST(pred_id AS STRING), '.txt') AS path FROM vertices"),
    "config_names": ("F13 S19", "SELECT DISTINCT config, lower(MATCH(config, '([A-Za-z]+)')) AS stem FROM results"),
    # contrastive losses
    "prototype_means": ("A1", "SELECT view_id, mask_id, i, round(avg(f), 6) AS f FROM pixel_dims GROUP BY view_id, mask_id, i"),
    "prototype_positive_loss": ("A2", "SELECT round(sum(pow(f - m, 2)) / count(DISTINCT pixel_id), 6) AS loss FROM (SELECT pixel_id, f, avg(f) OVER (PARTITION BY view_id, mask_id, i) AS m FROM pixel_dims) s"),
    "prototype_negative_hinge": ("J10", "WITH p AS (SELECT view_id, mask_id, i, avg(f) AS f FROM pixel_dims GROUP BY view_id, mask_id, i) SELECT view_id, round(avg(greatest(1 - d, 0)), 6) AS hinge FROM (SELECT a.view_id, a.mask_id, b.mask_id AS other, sqrt(sum(pow(a.f - b.f, 2))) AS d FROM p a JOIN p b ON a.view_id = b.view_id AND a.i = b.i AND a.mask_id < b.mask_id GROUP BY a.view_id, a.mask_id, b.mask_id) s GROUP BY view_id"),
    "multi_level_loss": ("A3", "SELECT round(sum(weight * total), 6) AS loss FROM (SELECT pixel_id % 3 AS level, avg(f * f) AS total FROM pixel_dims GROUP BY pixel_id % 3) s JOIN (SELECT CAST(i AS BIGINT) AS lv, 1.0 / (i + 1) AS weight FROM SEQ(0, 2)) w ON lv = level"),
    "group_slots": ("W4 F11", "SELECT pixel_id, view_id * 1024 + mask_id AS packed, CAST(row_number() OVER (PARTITION BY view_id, mask_id ORDER BY pixel_id) - 1 AS INT) AS slot FROM pixels"),
    # evidence
    "cooccurrence_votes": ("J4 D14", "SELECT u, v, CAST(agree AS BIGINT) AS agree, CAST(disagree AS BIGINT) AS disagree FROM votes"),
    "log_odds": ("A19", "SELECT u, v, round(greatest(-24, least(24, agree * ln(0.95 / 0.15) + disagree * ln(0.05 / 0.85))), 6) AS llr, round(1 / (1 + exp(-greatest(-24, least(24, ln(0.9 / 0.1) + agree * ln(0.95 / 0.15) + disagree * ln(0.05 / 0.85))))), 6) AS posterior FROM votes"),
    "vote_weights": ("G9", "SELECT e.u, e.v, round(0.3 - d + CASE WHEN agree + disagree > 0 THEN 0.3 * (agree - disagree) / greatest(agree + disagree, 1) ELSE 0 END, 6) AS w FROM edge_d e LEFT JOIN votes o ON o.u = e.u AND o.v = e.v"),
    "calibrate_distance": ("A15 A16 G8", "WITH o AS (SELECT d, 1 / (1 + exp(-greatest(-24, least(24, 0.2 * (agree - disagree))))) AS p, ntile(8) OVER (ORDER BY d, e.u, e.v) AS bin FROM edge_d e JOIN votes w ON w.u = e.u AND w.v = e.v) SELECT CAST(bin AS INT) AS bin, round(greatest(-12, least(12, ln((sum(p) + 1) / (sum(1 - p) + 1)))), 6) AS llr FROM o GROUP BY bin"),
    "vote_histogram": ("A18", "SELECT CAST(agree AS BIGINT) AS agree, CAST(disagree AS BIGINT) AS disagree, count(*) AS n FROM votes GROUP BY agree, disagree"),
    # retrieval
    "topk_instances_per_query": ("J18 O4", "SELECT q, cell_id, rank, round(s, 6) AS s FROM (SELECT p.pixel_id AS q, c.cell_id, DOT(p.feat, c.feat) AS s, CAST(row_number() OVER (PARTITION BY p.pixel_id ORDER BY round(DOT(p.feat, c.feat), 9) DESC, c.cell_id) AS INT) AS rank FROM pixels p JOIN cells c ON true WHERE p.pixel_id % 20 = 0) r WHERE rank <= 5"),
    "shifted_max_select": ("W9", "SELECT q, label FROM (SELECT q, label, s - min(s) OVER (PARTITION BY q) AS shifted, max(s) OVER (PARTITION BY q) - min(s) OVER (PARTITION BY q) AS top FROM (SELECT p.pixel_id AS q, l.label, round(avg(DOT(p.feat, c.feat)), 9) AS s FROM pixels p JOIN cells c ON true JOIN cell_labels l ON l.cell_id = c.cell_id AND l.label >= 0 WHERE p.pixel_id % 20 = 0 GROUP BY p.pixel_id, l.label) a) b WHERE shifted >= 0.85 * top"),
    "best_caption_match": ("J17 E6", "SELECT p.pixel_id AS q, l.label, round(max(DOT(p.feat, c.feat)), 6) AS best FROM pixels p JOIN cells c ON true JOIN cell_labels l ON l.cell_id = c.cell_id AND l.label >= 0 WHERE p.pixel_id % 20 = 0 GROUP BY p.pixel_id, l.label"),
    "view_ranking": ("O3", "SELECT obj_id, frame_idx, rank FROM (SELECT obj_id, frame_idx, CAST(row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, frame_idx) AS INT) AS rank FROM mask_sizes WHERE n >= 64) s WHERE rank <= 5"),
    "prompt_pooling": ("A34", "SELECT mask_id, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY mask_id)), 6) AS f FROM (SELECT mask_id, d.i, avg(d.f / n) AS m FROM pixel_dims d JOIN (SELECT pixel_id AS pid, sqrt(sum(f * f)) AS n FROM pixel_dims GROUP BY pixel_id) s ON pid = d.pixel_id GROUP BY mask_id, d.i) p"),
    "discriminant_statistics": ("A21 C13", "SELECT i, round(avg(CASE WHEN label = 3 THEN f END), 6) AS mean_in, round(avg(CASE WHEN label <> 3 THEN f END), 6) AS mean_out, round((avg(CASE WHEN label = 3 THEN f END) - avg(CASE WHEN label <> 3 THEN f END)) / (var_pop(CASE WHEN label = 3 THEN f END) + var_pop(CASE WHEN label <> 3 THEN f END)), 6) AS direction FROM cell_dims GROUP BY i"),
    "caption_text": ("F14", "SELECT DISTINCT c_mktsegment, concat(lower(trim(c_mktsegment)), '.') AS prompt FROM {customer}"),
    # sampling, splits, schedules
    "strided_sample": ("O8 S8", "SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS r FROM cells) s WHERE r % 8 = 0"),
    "holdout_split": ("S6 J14", "SELECT vec_id, CASE WHEN r % 8 = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM {embeddings}) s"),
    "hashed_batch": ("S22 F4 S23", "SELECT j, (j * 2654435761) % 4294967296 % n AS pick FROM (SELECT CAST(i AS BIGINT) AS j FROM SEQ(0, 63)) b JOIN (SELECT count(*) AS n FROM {embeddings}) c ON true"),
    "weighted_sample": ("O6 O7", "SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY -ln(((cell_id * 7919 + 13) % 10007 + 1) / 10008.0) / (density + 1e-3), cell_id) AS k FROM cells) s WHERE k <= 50"),
    "lr_schedule": ("W12", "SELECT CAST(i AS INT) AS step, round(CASE WHEN i < 100 THEN 0.01 * i / 100 WHEN i <= 1000 THEN 0.0001 + 0.5 * (0.01 - 0.0001) * (1 + cos(3.141592653589793 * (i - 100) / 900)) ELSE 0 END, 9) AS lr FROM SEQ(0, 1100)"),
    "palette": ("F12", "SELECT CAST(i AS INT) AS label, round((i * 0.618033988749895) % 1, 9) AS hue FROM SEQ(0, 99)"),
    # frames
    "reseed_windows": ("T1", "SELECT user_id, CAST(floor((step - 1) / 10) AS BIGINT) AS segment, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM {events}) s GROUP BY user_id, CAST(floor((step - 1) / 10) AS BIGINT)"),
    "tracker_sessions": ("T2", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(CASE WHEN prev IS NULL OR t - prev > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM (SELECT user_id, event_id, EPOCH(ts) AS t, lag(EPOCH(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) a) b GROUP BY user_id, session"),
    "live_object_cap": ("T3", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM {events}) s WHERE k <= 8"),
    "overlap_upsert": ("T5 T6 T7", "SELECT frame, segment FROM (SELECT frame, segment, row_number() OVER (PARTITION BY frame ORDER BY segment DESC) AS k FROM (SELECT CAST(i AS BIGINT) AS frame, CAST(floor(i / 10) AS BIGINT) AS segment FROM SEQ(0, 50) UNION ALL SELECT CAST(i AS BIGINT), CAST(floor(i / 10) - 1 AS BIGINT) FROM SEQ(1, 50) WHERE i % 10 = 0) a) b WHERE k = 1"),
    "removal_edit": ("E8", "SELECT l.label, count(*) AS cells, round(sum(CASE WHEN l.label = 2 THEN ln(1 + exp(-20.0)) ELSE density END), 6) AS density FROM cells c JOIN cell_labels l ON l.cell_id = c.cell_id GROUP BY l.label"),
}
