"""DuckDB SQL for the catalogue's queries, written cell by cell without any of the engine's shortcuts."""

from __future__ import annotations

_BASE = """
WITH RECURSIVE
g AS (SELECT ceil(sqrt(count(*)))::BIGINT AS g FROM lineitem),
scenes AS (
  SELECT l_orderkey % g AS "row", (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % g AS col,
         l_shipdate AS acquired_at,
         greatest(0.0, round(l_discount * 100) - 6)::DOUBLE / 8.0 AS crop_prob,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END::BIGINT AS forest2020,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 50 THEN year(l_shipdate) - 1978 ELSE 0 END::BIGINT AS lossyear,
         100.0::DOUBLE AS area_m2,
         l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice
  FROM lineitem, g),
cells AS (
  SELECT "row", col, crop_prob, forest2020, lossyear, area_m2,
         (lossyear >= 21 AND forest2020 = 1) AS loss
  FROM scenes
  QUALIFY row_number() OVER (PARTITION BY "row", col
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC,
             l_extendedprice DESC) = 1),
boxes AS (
  SELECT *, r0 + height - 1 AS r1, c0 + width - 1 AS c1 FROM (
    SELECT c_custkey AS farm_id, (c_custkey * 37) % (g - 8) AS r0,
           (c_custkey * 101 + c_nationkey * 13) % (g - 8) AS c0,
           2 + c_nationkey % 7 AS height, 2 + c_custkey % 5 AS width
    FROM customer, g)),
farms AS (
  SELECT farm_id, (height * width)::DOUBLE * 0.01 AS area_ha, (height * width)::BIGINT AS n_cells,
         '{"type":"Polygon","coordinates":[[[' || x1 || ',' || y1 || '],[' || x2 || ',' || y1 || '],['
           || x2 || ',' || y2 || '],[' || x1 || ',' || y2 || '],[' || x1 || ',' || y1 || ']]]}' AS geometry,
         x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2
  FROM (SELECT *, (c0 * 10.0)::DOUBLE::VARCHAR AS x1, (r0 * 10.0)::DOUBLE::VARCHAR AS y1,
               ((c0 + width) * 10.0)::DOUBLE::VARCHAR AS x2, ((r0 + height) * 10.0)::DOUBLE::VARCHAR AS y2 FROM boxes)),
near AS (
  SELECT b.farm_id, c.area_m2, c.lossyear, c.loss,
         greatest(b.r0 - c.row, c.row - b.r1, 0) ** 2 + greatest(b.c0 - c.col, c.col - b.c1, 0) ** 2 AS d2
  FROM boxes b JOIN cells c ON c.row BETWEEN b.r0 - 10 AND b.r1 + 10 AND c.col BETWEEN b.c0 - 10 AND b.c1 + 10),
sums AS (
  SELECT farm_id,
         sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 = 0) AS defo_m2,
         sum(area_m2) FILTER (WHERE d2 = 0) AS total_m2,
         sum(lossyear) FILTER (WHERE d2 = 0) AS lossyear,
         sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 > 0 AND d2 <= 4) AS d20,
         sum(area_m2) FILTER (WHERE d2 > 0 AND d2 <= 4) AS t20,
         sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 > 0 AND d2 <= 25) AS d50,
         sum(area_m2) FILTER (WHERE d2 > 0 AND d2 <= 25) AS t50,
         sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 > 0 AND d2 <= 100) AS d100,
         sum(area_m2) FILTER (WHERE d2 > 0 AND d2 <= 100) AS t100
  FROM near GROUP BY farm_id),
shares AS (
  SELECT b.farm_id, defo_m2, total_m2, lossyear,
         round_even(defo_m2 / total_m2 * 100, 3) AS defo_pct,
         round_even(d20 / t20 * 100, 3) AS nb_defo_pct_20,
         round_even(d50 / t50 * 100, 3) AS nb_defo_pct_50,
         round_even(d100 / t100 * 100, 3) AS nb_defo_pct_100
  FROM boxes b LEFT JOIN sums USING (farm_id)),
assessments AS (
  SELECT farm_id, defo_m2, total_m2, defo_pct, nb_defo_pct_100 / 100.0 AS risk_score,
         CASE WHEN defo_pct = 0 THEN 'LOW' WHEN defo_pct <= 5.3755 THEN 'MEDIUM' WHEN defo_pct > 5.3755 THEN 'HIGH' END
           AS risk_class,
         CASE WHEN defo_pct > 0 THEN 'AFFECTED' WHEN defo_pct <= 0 THEN 'CLEAN' END AS risk_binary
  FROM shares),
parcel_view AS (
  SELECT f.farm_id, f.area_ha, a.defo_pct, a.risk_score, a.risk_class, f.geometry
  FROM farms f JOIN assessments a ON f.farm_id = a.farm_id),
points AS (
  SELECT farm_id, (height * width)::BIGINT AS n_cells, r0 + (height - 1) / 2.0::DOUBLE AS row_mean,
         c0 + (width - 1) / 2.0::DOUBLE AS col_mean,
         floor(r0 + (height - 1) / 2.0::DOUBLE + 0.5)::BIGINT AS crow,
         floor(c0 + (width - 1) / 2.0::DOUBLE + 0.5)::BIGINT AS ccol
  FROM boxes),
losses AS (SELECT "row", col FROM cells WHERE loss),
reach AS (
  SELECT p.farm_id, (p.crow - l.row) ** 2 + (p.ccol - l.col) ** 2 AS d2,
         l.row BETWEEN b.r0 AND b.r1 AND l.col BETWEEN b.c0 AND b.c1 AS own
  FROM points p JOIN boxes b USING (farm_id)
  JOIN losses l ON l.row BETWEEN p.crow - 15 AND p.crow + 15 AND l.col BETWEEN p.ccol - 15 AND p.ccol + 15),
nearest AS (
  SELECT p.farm_id, min(d2) FILTER (WHERE d2 <= 225) AS d2,
         min(d2) FILTER (WHERE d2 <= 225 AND NOT own) AS d2_masked
  FROM points p LEFT JOIN reach USING (farm_id) GROUP BY p.farm_id),
distances AS (
  SELECT farm_id, coalesce(round_even(least(sqrt(d2) * 10, 150), 1), 150)::DOUBLE AS dist_to_defo_m,
         coalesce(round_even(least(sqrt(d2_masked) * 10, 150), 1), 150)::DOUBLE AS dist_to_defo_m_masked
  FROM nearest),
frame AS (
  SELECT farm_id, area_ha, a.defo_pct, nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100, dist_to_defo_m,
         dist_to_defo_m_masked, a.risk_class, a.risk_binary
  FROM farms JOIN assessments a USING (farm_id) JOIN shares USING (farm_id) JOIN distances USING (farm_id)),
ranked AS (
  SELECT farm_id, risk_score, risk_class, CASE WHEN defo_pct > 0 THEN 1 ELSE 0 END AS hit,
         CASE WHEN risk_score * 100 = 0 THEN 'LOW' WHEN risk_score * 100 <= 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS predicted
  FROM assessments WHERE risk_class IS NOT NULL AND risk_score IS NOT NULL),
mask AS (SELECT "row", col, "row" * 2147483648 + col AS id FROM cells WHERE crop_prob > 0.3),
steps AS (SELECT * FROM range(-1, 2) AS a(dr), range(-1, 2) AS b(dc)),
links AS (
  SELECT a.id AS a, b.id AS b
  FROM (SELECT id, "row" + dr AS "row", col + dc AS col FROM mask, steps) a JOIN mask b ON a.row = b.row AND a.col = b.col),
closure AS (
  SELECT id AS root, id FROM mask
  UNION
  SELECT c.root, l.b FROM closure c JOIN links l ON c.id = l.a),
comps AS (
  SELECT m.row, m.col, min(c.root) AS comp_id FROM closure c JOIN mask m ON c.id = m.id GROUP BY m.row, m.col),
sizes AS (SELECT comp_id, count(*)::BIGINT AS n_cells FROM comps GROUP BY comp_id),
rough AS (
  SELECT r AS "row", c AS col, r * 2147483648 + c AS id FROM (
    SELECT "row" // 4 AS r, col // 4 AS c, avg(crop_prob) AS p FROM cells GROUP BY 1, 2) WHERE p > 0.15),
rough_links AS (
  SELECT a.id AS a, b.id AS b
  FROM (SELECT id, "row" + dr AS "row", col + dc AS col FROM rough, steps) a JOIN rough b ON a.row = b.row AND a.col = b.col),
rough_closure AS (
  SELECT id AS root, id FROM rough
  UNION
  SELECT c.root, l.b FROM rough_closure c JOIN rough_links l ON c.id = l.a),
rough_comps AS (
  SELECT m.row, m.col, min(c.root) AS comp_id FROM rough_closure c JOIN rough m ON c.id = m.id GROUP BY m.row, m.col),
centre AS (
  SELECT sum("row")::DOUBLE / count(*) * 4 + 1.5 AS y, sum(col)::DOUBLE / count(*) * 4 + 1.5 AS x FROM rough_comps
  WHERE comp_id = (SELECT comp_id FROM rough_comps GROUP BY comp_id ORDER BY count(*) DESC, comp_id LIMIT 1)),
area_cells AS (
  SELECT c.* FROM cells c, centre
  WHERE c.row >= y - 40 AND c.row < y + 40 AND c.col >= x - 40 AND c.col < x + 40),
fine AS (SELECT "row", col, "row" * 2147483648 + col AS id FROM area_cells WHERE crop_prob > 0.15),
fine_links AS (
  SELECT a.id AS a, b.id AS b
  FROM (SELECT id, "row" + dr AS "row", col + dc AS col FROM fine, steps) a JOIN fine b ON a.row = b.row AND a.col = b.col),
fine_closure AS (
  SELECT id AS root, id FROM fine
  UNION
  SELECT c.root, l.b FROM fine_closure c JOIN fine_links l ON c.id = l.a),
fine_sizes AS (
  SELECT comp_id, count(*)::BIGINT AS n_cells FROM (
    SELECT id, min(root) AS comp_id FROM fine_closure GROUP BY id) GROUP BY comp_id)
"""


def _ranking(rows: str) -> str:
    """Rank metrics of ``rows(feature, value, hit)``."""
    return f""",
rank_rows AS ({rows}),
levels AS (
  SELECT feature, value, sum(hit) AS pos, sum(1 - hit) AS neg FROM rank_rows WHERE value IS NOT NULL GROUP BY 1, 2),
curve AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY feature) AS p, sum(neg) OVER (PARTITION BY feature) AS n
  FROM levels WINDOW w AS (PARTITION BY feature ORDER BY value DESC)),
rank_metrics AS (
  SELECT feature, round(sum(pos * (2 * (n - fp) + neg))::DOUBLE / (2.0::DOUBLE * max(p) * max(n)), 6) AS roc_auc,
         round(sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p), 6) AS pr_auc
  FROM curve GROUP BY feature)
"""


# the same features with rings of 200, 500 and 1000 m and a cap of 2560 m
_REAL = """,
wide AS (
  SELECT b.farm_id, c.area_m2, c.loss,
         greatest(b.r0 - c.row, c.row - b.r1, 0) ** 2 + greatest(b.c0 - c.col, c.col - b.c1, 0) ** 2 AS d2
  FROM boxes b JOIN cells c ON c.row BETWEEN b.r0 - 100 AND b.r1 + 100 AND c.col BETWEEN b.c0 - 100 AND b.c1 + 100),
wide_sums AS (
  SELECT farm_id, sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 = 0) AS defo_m2,
         sum(area_m2) FILTER (WHERE d2 = 0) AS total_m2,
         sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 > 0 AND d2 <= 400) AS d200,
         sum(area_m2) FILTER (WHERE d2 > 0 AND d2 <= 400) AS t200,
         sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 > 0 AND d2 <= 2500) AS d500,
         sum(area_m2) FILTER (WHERE d2 > 0 AND d2 <= 2500) AS t500,
         sum(CASE WHEN loss THEN area_m2 ELSE 0 END) FILTER (WHERE d2 > 0 AND d2 <= 10000) AS d1000,
         sum(area_m2) FILTER (WHERE d2 > 0 AND d2 <= 10000) AS t1000
  FROM wide GROUP BY farm_id),
wide_shares AS (
  SELECT b.farm_id, defo_m2, total_m2, round_even(defo_m2 / total_m2 * 100, 3) AS defo_pct,
         round_even(d200 / t200 * 100, 3) AS nb_defo_pct_200, round_even(d500 / t500 * 100, 3) AS nb_defo_pct_500,
         round_even(d1000 / t1000 * 100, 3) AS nb_defo_pct_1000
  FROM boxes b LEFT JOIN wide_sums USING (farm_id)),
wide_near AS (
  SELECT p.farm_id, (p.crow - l.row) ** 2 + (p.ccol - l.col) ** 2 AS d2,
         l.row BETWEEN b.r0 AND b.r1 AND l.col BETWEEN b.c0 AND b.c1 AS own
  FROM points p JOIN boxes b USING (farm_id)
  JOIN losses l ON l.row BETWEEN p.crow - 256 AND p.crow + 256 AND l.col BETWEEN p.ccol - 256 AND p.ccol + 256),
wide_distances AS (
  SELECT p.farm_id,
         coalesce(round_even(least(sqrt(min(d2) FILTER (WHERE d2 <= 65536)) * 10, 2560), 1), 2560)::DOUBLE AS dist_to_defo_m,
         coalesce(round_even(least(sqrt(min(d2) FILTER (WHERE d2 <= 65536 AND NOT own)) * 10, 2560), 1), 2560)::DOUBLE
           AS dist_to_defo_m_masked
  FROM points p LEFT JOIN wide_near USING (farm_id) GROUP BY p.farm_id),
wide_frame AS (
  SELECT farm_id, risk_binary, nb_defo_pct_200 IS NOT NULL AS has_200,
         nb_defo_pct_200 IS NOT NULL AND nb_defo_pct_500 IS NOT NULL AND nb_defo_pct_1000 IS NOT NULL AS has_rings
  FROM wide_shares JOIN (SELECT farm_id, risk_binary FROM assessments) USING (farm_id))
"""

_SCORE_ROWS = "SELECT 'score' AS feature, risk_score AS value, hit FROM ranked"

_MATRIX = """,
names AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH']) AS label),
matrix AS (
  SELECT a.label, b.label AS predicted,
         (SELECT count(*) FROM ranked r WHERE r.risk_class = a.label AND r.predicted = b.label)::BIGINT AS n
  FROM names a, names b),
per_class AS (
  SELECT label, tp, support, guessed,
         coalesce(tp / nullif(guessed, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall,
         coalesce(2 * tp / nullif(guessed + support, 0), 0)::DOUBLE AS f1
  FROM (SELECT label, sum(CASE WHEN label = predicted THEN n ELSE 0 END)::DOUBLE AS tp, sum(n)::BIGINT AS support FROM matrix GROUP BY label)
  JOIN (SELECT predicted AS label, sum(n)::BIGINT AS guessed FROM matrix GROUP BY predicted) USING (label))
"""

_QUERIES = {
    # ---- sources
    "read_boundary_by_name": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_name = 'NATION_3'",
    "scenes_between": """
        SELECT "row", count(*)::BIGINT AS n_scenes, max(col) AS max_col FROM scenes
        WHERE acquired_at >= TIMESTAMP '1997-01-01' AND acquired_at < TIMESTAMP '1998-01-01' GROUP BY "row" """,
    "band": 'SELECT "row", col, lossyear FROM cells WHERE lossyear IS NOT NULL',
    "table_query": """
        SELECT 'cocoa' AS commodity, count(*) AS n_farms, sum(area_ha) AS area_ha,
               count(*) FILTER (WHERE defo_pct > 0) AS n_affected FROM parcel_view""",
    "column_defaults": "SELECT farm_id, 'cocoa' AS commodity, '2026-01-01' AS assessed_on FROM farms",
    "key_violations": """
        SELECT problem, farm_id, n_rows FROM (
          SELECT 'farm key' AS problem, c_custkey AS farm_id, count(*)::BIGINT AS n_rows FROM customer
            GROUP BY 2 HAVING count(*) > 1
          UNION ALL
          SELECT 'no farm', o_custkey + o_orderkey % 2, count(*) FROM orders
            WHERE o_custkey + o_orderkey % 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
          UNION ALL
          SELECT 'many assessments', o_custkey + o_orderkey % 2, count(*) FROM orders GROUP BY 2 HAVING count(*) > 1)""",
    "latest_assessment": """
        SELECT o_custkey AS farm_id, o_orderkey AS id, o_totalprice AS value FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1""",
    "apply_new_scores": """
        SELECT farm_id, CASE WHEN defo_pct > 0 THEN 0.9 ELSE risk_score END::DOUBLE AS risk_score,
               CASE WHEN defo_pct > 0 THEN 'HIGH' ELSE risk_class END AS risk_class FROM assessments""",
    "union_parts": "SELECT farm_id, defo_pct FROM assessments WHERE defo_pct IS NOT NULL",
    "geojson_files": "SELECT farm_id, area_ha, n_cells, 'cocoa' AS commodity, geometry FROM farms",
    "feature_files": "SELECT farm_id, defo_m2, total_m2, defo_pct FROM assessments",
    "stored_tables": "SELECT farm_id, defo_pct, risk_score, risk_class FROM assessments",
    "updated_tables": """
        SELECT farm_id, defo_pct, CASE WHEN defo_pct > 0 AND risk_score > 0.01 THEN 0.95 ELSE risk_score END::DOUBLE AS risk_score,
               CASE WHEN defo_pct > 0 THEN risk_class ELSE 'SEEN' END AS risk_class FROM assessments""",
    # ---- raster
    "threshold": 'SELECT "row", col, crop_prob FROM cells WHERE crop_prob > 0.3',
    "mosaic_masked": """
        SELECT "row", col, (list(crop_prob ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC,
                 l_linenumber DESC, l_extendedprice DESC) FILTER (WHERE l_linenumber % 3 <> 0))[1] AS crop_prob,
               (list(lossyear ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC,
                 l_linenumber DESC, l_extendedprice DESC))[1] AS lossyear
        FROM scenes GROUP BY "row", col""",
    "mosaic": 'SELECT "row", col, crop_prob, forest2020, lossyear FROM cells',
    "clip": """
        SELECT "row", col, crop_prob FROM cells c WHERE EXISTS (
          SELECT 1 FROM boxes b WHERE c.row BETWEEN b.r0 AND b.r1 AND c.col BETWEEN b.c0 AND b.c1)""",
    "clip_boundary": """
        SELECT "row", col, crop_prob FROM (SELECT *, "row" + 0.5 AS y, col + 0.5 AS x, g // 10 AS a FROM cells, g)
        WHERE (x > a AND x < a * 5 AND y > a AND y < a * 5
               AND NOT (x > a * 2 AND x < a * 4 AND y > a * 2 AND y < a * 3 + 2))
           OR (x > a * 6 AND y > a * 6 + 2 AND x - a * 6 + y - a * 6 - 2 < a * 3 + 0.25)""",
    "tile_directory": """
        SELECT ("row" >> 5) || '_' || (col >> 5) AS tile, count(*) AS n_cells, min("row") AS row_lo, max("row") AS row_hi,
               min(col) AS col_lo, max(col) AS col_hi FROM cells GROUP BY 1""",
    "loss_mask": 'SELECT "row", col, loss FROM cells',
    "pixel_area": """
        SELECT DISTINCT "row", round(6371008.8 ** 2 * radians(0.0001)
          * (sin(radians(9.0) - "row" * radians(0.0001)) - sin(radians(9.0) - ("row" + 1) * radians(0.0001))), 6) AS area_m2
        FROM cells""",
    "with_bands": 'SELECT "row", col, CASE WHEN loss THEN area_m2 ELSE 0 END::DOUBLE AS defo_m2, area_m2 AS total_m2 FROM cells',
    "resample": """
        SELECT "row" // 10 AS "row", col // 10 AS col, round(avg(crop_prob), 6) AS crop_prob, sum(area_m2) AS area_m2
        FROM cells GROUP BY 1, 2""",
    "erase_own": """
        SELECT "row", col FROM losses l WHERE NOT EXISTS (
          SELECT 1 FROM boxes b WHERE b.farm_id = (SELECT min(farm_id) FROM shares WHERE defo_pct > 0)
            AND l.row BETWEEN b.r0 AND b.r1 AND l.col BETWEEN b.c0 AND b.c1)""",
    # ---- clusters and parcels
    "connected_components": 'SELECT "row", col, comp_id FROM comps',
    "component_size": "SELECT comp_id, n_cells FROM sizes",
    "component_area_km2": "SELECT comp_id, round(n_cells * 100 / 1e6, 6)::DOUBLE AS area_km2 FROM sizes",
    "largest_component": """
        SELECT comp_id, round(n_cells * 100 / 1e6, 6)::DOUBLE AS area_km2 FROM sizes ORDER BY n_cells DESC, comp_id LIMIT 1""",
    "filter_size": "SELECT comp_id, n_cells FROM sizes WHERE n_cells BETWEEN 3 AND 8",
    "centroid": "SELECT * FROM points",
    "aoi_box": """
        SELECT ceil(row_mean - 20)::BIGINT AS row_lo, ceil(row_mean + 20)::BIGINT - 1 AS row_hi,
               ceil(col_mean - 20)::BIGINT AS col_lo, ceil(col_mean + 20)::BIGINT - 1 AS col_hi,
               40::BIGINT AS n_rows, count(*)::BIGINT AS n FROM points GROUP BY 1, 2, 3, 4""",
    "study_area_cells": 'SELECT "row", col, crop_prob FROM area_cells',
    "assign_farm_id": """
        SELECT comp_id, n_cells, row_number() OVER (ORDER BY comp_id) - 1 AS farm_id FROM sizes WHERE n_cells BETWEEN 3 AND 8""",
    "area_ha": "SELECT comp_id, round(n_cells * 0.01::DOUBLE, 2) AS area_ha FROM sizes",
    "build_parcels": """
        SELECT row_number() OVER (ORDER BY comp_id) - 1 AS farm_id, n_cells, round(n_cells * 0.01::DOUBLE, 2) AS area_ha
        FROM fine_sizes WHERE n_cells BETWEEN 3 AND 8""",
    "outline_perimeter": """
        SELECT comp_id, sum(4 - (SELECT count(*) FROM mask n
          WHERE (n.row = c.row AND abs(n.col - c.col) = 1) OR (n.col = c.col AND abs(n.row - c.row) = 1)))::BIGINT AS perimeter
        FROM comps c GROUP BY comp_id""",
    "polygonize_parcels": "SELECT farm_id, geometry FROM farms",
    "polygonize_area": "SELECT comp_id, n_cells FROM sizes",
    "outline_parts": "SELECT comp_id, n_cells FROM sizes",
    # ---- zonal and proximity
    "polygon_runs": 'SELECT farm_id, unnest(range(r0, r1 + 1)) AS "row", c0 AS col_lo, c1 AS col_hi FROM boxes',
    "zonal_sum": "SELECT farm_id, defo_m2, total_m2, lossyear::DOUBLE AS lossyear FROM shares",
    "defo_pct": "SELECT farm_id, defo_m2, total_m2, defo_pct FROM shares",
    "buffer_runs": """
        SELECT farm_id, "row", c0 - w AS col_lo, c1 + w AS col_hi FROM (
          SELECT *, floor(sqrt(25 - greatest(r0 - "row", "row" - r1, 0) ** 2))::BIGINT AS w FROM (
            SELECT *, unnest(range(r0 - 5, r1 + 6)) AS "row" FROM boxes))""",
    "ring_runs": """
        SELECT farm_id, "row", c0 - w AS col_lo, CASE WHEN "row" BETWEEN r0 AND r1 THEN c0 - 1 ELSE c1 + w END AS col_hi FROM (
          SELECT *, floor(sqrt(25 - greatest(r0 - "row", "row" - r1, 0) ** 2))::BIGINT AS w FROM (
            SELECT *, unnest(range(r0 - 5, r1 + 6)) AS "row" FROM boxes))
        UNION ALL
        SELECT farm_id, unnest(range(r0, r1 + 1)), c1 + 1, c1 + 5 FROM boxes""",
    "assessed_parcels": """
        SELECT farm_id, defo_pct, NULL::DOUBLE AS risk_score, NULL::VARCHAR AS risk_class, '2026-01-01' AS assessed_on
        FROM shares""",
    "ring_features": "SELECT farm_id, nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100 FROM shares",
    "parcel_context": """
        SELECT farm_id, defo_m2, total_m2, defo_pct, nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100 FROM shares""",
    "nearest_loss": "SELECT farm_id, d2::BIGINT AS dist_px2 FROM nearest",
    "nearest_loss_excluding_own": "SELECT farm_id, d2_masked::BIGINT AS dist_px2 FROM nearest",
    "cap_distance_m": """
        SELECT farm_id, coalesce(round_even(least(sqrt(d2) * 10, 120), 1), 120)::DOUBLE AS dist_to_defo_m FROM nearest""",
    "distance_feature": "SELECT farm_id, dist_to_defo_m FROM distances",
    "sample_at": """
        SELECT farm_id, crop_prob FROM points p LEFT JOIN cells c ON c.row = p.crow AND c.col = p.ccol""",
    "masked_distance": """
        SELECT farm_id, dist_to_defo_m_masked FROM distances JOIN shares USING (farm_id) WHERE defo_pct IS NOT NULL""",
    "both_distances": "SELECT farm_id, dist_to_defo_m, dist_to_defo_m_masked FROM distances",
    "context_features": """
        SELECT farm_id, defo_m2, total_m2, defo_pct, nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100, dist_to_defo_m,
               dist_to_defo_m_masked FROM shares JOIN distances USING (farm_id)""",
    "parcel_context_real": _REAL + "SELECT * FROM wide_shares",
    "distance_band": """
        SELECT c.row, c.col,
               coalesce(round_even(least(sqrt(min((c.row - l.row) ** 2 + (c.col - l.col) ** 2)) * 10, 2560), 1), 2560)::DOUBLE AS dist_to_defo_m
        FROM cells c LEFT JOIN losses l ON l.row BETWEEN c.row - 256 AND c.row + 256 AND l.col BETWEEN c.col - 256 AND c.col + 256
        GROUP BY c.row, c.col""",
    "both_distances_real": _REAL + "SELECT * FROM wide_distances",
    "masking_report": """
        SELECT count(*)::BIGINT AS n_affected, count(*) FILTER (WHERE dist_to_defo_m = 0)::BIGINT AS n_was_zero,
               count(*) FILTER (WHERE dist_to_defo_m = 0 AND dist_to_defo_m_masked > 0)::BIGINT AS n_now_positive,
               round_even(median(round_even(dist_to_defo_m_masked - dist_to_defo_m, 1)), 1) AS median_delta
        FROM distances JOIN shares USING (farm_id) WHERE defo_pct > 0""",
    # ---- relational and serving
    "parcels_view": "SELECT * FROM parcel_view",
    "model_frame": "SELECT * FROM frame",
    "semi_filter": "SELECT farm_id, area_ha FROM farms WHERE farm_id IN (SELECT farm_id FROM shares WHERE defo_pct > 0)",
    "list_farms": """
        SELECT farm_id, area_ha, defo_pct, risk_score, risk_class FROM parcel_view
        WHERE risk_class = 'LOW' AND risk_score >= 0.001 ORDER BY farm_id LIMIT 100 OFFSET 50""",
    "list_farms_first_page": """
        SELECT farm_id, area_ha, defo_pct, risk_score, risk_class FROM parcel_view ORDER BY farm_id LIMIT 100""",
    "get_farm": "SELECT * FROM parcel_view WHERE farm_id = 42",
    "projection": "SELECT farm_id AS parcel, geometry AS geom FROM farms",
    "page": "SELECT farm_id, area_ha FROM farms ORDER BY farm_id LIMIT 25 OFFSET 100",
    "page_after": "SELECT farm_id, area_ha FROM farms WHERE farm_id > 100 ORDER BY farm_id LIMIT 25",
    "early_warning": """
        SELECT farm_id, area_ha, defo_pct, risk_score FROM parcel_view WHERE risk_class = 'LOW'
        ORDER BY risk_score DESC NULLS LAST, farm_id LIMIT 10""",
    "top_loss": "SELECT farm_id, area_ha, defo_pct FROM parcel_view ORDER BY defo_pct DESC NULLS LAST, farm_id LIMIT 10",
    "sort_by_score": "SELECT farm_id, risk_score FROM assessments ORDER BY risk_score DESC NULLS LAST, farm_id",
    "class_stats": """
        SELECT risk_class, count(*)::BIGINT AS count, round(avg(risk_score), 6) AS avg_risk_score,
               min(risk_score) AS min_risk_score, max(risk_score) AS max_risk_score FROM assessments GROUP BY risk_class""",
    "score_summary": """
        SELECT risk_class, count(*)::BIGINT AS n, round(avg(risk_score), 4) AS avg_score,
               round(min(risk_score), 4) AS min_score, round(max(risk_score), 4) AS max_score
        FROM assessments GROUP BY risk_class""",
    "totals": "SELECT count(*)::BIGINT AS total_parcels, round(coalesce(sum(area_ha), 0), 2) AS total_area_ha FROM farms",
    "count_where": """
        SELECT count(*) FILTER (WHERE defo_pct > 0)::BIGINT AS n_affected, count(*) FILTER (WHERE defo_pct = 0)::BIGINT AS n_clean,
               count(*) FILTER (WHERE defo_pct > 50)::BIGINT AS n_half,
               count(*) FILTER (WHERE defo_pct IS NULL)::BIGINT AS n_unknown FROM assessments""",
    "column_delta": """
        SELECT count(*) FILTER (WHERE dist_to_defo_m IS DISTINCT FROM dist_to_defo_m_masked)::BIGINT AS n_changed,
               round(max(abs(dist_to_defo_m_masked - dist_to_defo_m)), 1) AS max_abs_delta FROM distances""",
    "value_counts": "SELECT risk_class, count(*)::BIGINT AS count FROM assessments GROUP BY risk_class",
    "describe": """
        SELECT "column", count(value)::BIGINT AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
               round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50,
               round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max
        FROM (SELECT nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100 FROM shares)
        UNPIVOT (value FOR "column" IN (nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100)) GROUP BY "column" """,
    "affected_quantiles": """
        SELECT round(quantile_cont(defo_pct, 0.25), 4) AS q25, round(quantile_cont(defo_pct, 0.5), 4) AS q50,
               round(quantile_cont(defo_pct, 0.75), 4) AS q75, round(quantile_cont(defo_pct, 0.9), 4) AS q90
        FROM assessments WHERE defo_pct > 0""",
    "median_threshold": "SELECT round(median(defo_pct), 4) AS threshold FROM assessments WHERE defo_pct > 0",
    "classes_by_learnt_median": """
        SELECT farm_id, CASE WHEN defo_pct = 0 THEN 'LOW'
          WHEN defo_pct <= (SELECT median(defo_pct) FROM shares WHERE defo_pct > 0) THEN 'MEDIUM'
          WHEN defo_pct > 0 THEN 'HIGH' END AS risk_class FROM shares""",
    "verify_scores": """
        SELECT count(risk_score)::BIGINT AS n_scored, min(risk_score) AS min_score, max(risk_score) AS max_score,
               count(risk_score) = (SELECT count(*) FROM customer) AND min(risk_score) >= 0 AND max(risk_score) <= 1 AS ok
        FROM assessments""",
    "head": "SELECT farm_id, n_cells, area_ha FROM farms ORDER BY farm_id LIMIT 5",
    # ---- labels and documents
    "risk_class_label": "SELECT farm_id, risk_class FROM assessments",
    "risk_binary_label": "SELECT farm_id, risk_binary FROM assessments",
    "compliance_wording": """
        SELECT farm_id, CASE risk_class WHEN 'LOW' THEN 'Compliant' WHEN 'MEDIUM' THEN 'Needs review'
          WHEN 'HIGH' THEN 'Non-compliant' END AS label FROM assessments""",
    "to_feature_text": """
        SELECT 'Feature' AS type, 'Polygon' AS geometry_type, farm_id, area_ha, defo_pct, risk_score, risk_class FROM parcel_view""",
    "feature_collection_size": """
        SELECT 'FeatureCollection' AS type, row_number() OVER (ORDER BY farm_id) - 1 AS place, farm_id
        FROM (SELECT farm_id FROM parcel_view ORDER BY farm_id LIMIT 100)""",
    "geometry_round_trip": """
        SELECT farm_id, 0::BIGINT AS place, x1 AS x, y1 AS y FROM farms
        UNION ALL SELECT farm_id, 1, x2, y1 FROM farms
        UNION ALL SELECT farm_id, 2, x2, y2 FROM farms
        UNION ALL SELECT farm_id, 3, x1, y2 FROM farms
        UNION ALL SELECT farm_id, 4, x1, y1 FROM farms""",
    "stats_document": """
        SELECT (SELECT count(*) FROM farms)::BIGINT AS total_parcels,
               (SELECT round(sum(area_ha), 2) FROM farms) AS total_area_ha,
               (SELECT count(*) FROM assessments WHERE risk_class IS NULL)::BIGINT AS unclassified,
               row_number() OVER (ORDER BY avg(risk_score) DESC NULLS LAST) - 1 AS place,
               risk_class, count(*)::BIGINT AS count, round(avg(risk_score), 4) AS avg_risk_score,
               min(risk_score) AS min_risk_score, max(risk_score) AS max_risk_score
        FROM assessments WHERE risk_class IS NOT NULL GROUP BY risk_class""",
    "browse": """
        SELECT farm_id, area_ha, risk_class FROM parcel_view WHERE risk_class IN ('LOW', 'HIGH')
        ORDER BY farm_id LIMIT 50 OFFSET 100""",
    "page_directory": """
        SELECT 'first' AS request, farm_id, area_ha, risk_score, risk_class FROM (SELECT * FROM parcel_view ORDER BY farm_id LIMIT 40)
        UNION ALL SELECT 'across', farm_id, area_ha, risk_score, risk_class
          FROM (SELECT * FROM parcel_view ORDER BY farm_id LIMIT 600 OFFSET 100)
        UNION ALL SELECT 'class', farm_id, area_ha, risk_score, risk_class
          FROM (SELECT * FROM parcel_view WHERE risk_class IS NOT NULL ORDER BY farm_id LIMIT 30 OFFSET 60)
        UNION ALL SELECT 'score', farm_id, area_ha, risk_score, risk_class
          FROM (SELECT * FROM parcel_view WHERE risk_class = 'LOW' AND risk_score >= 0.001 ORDER BY farm_id LIMIT 25 OFFSET 10)
        UNION ALL SELECT 'last', farm_id, area_ha, risk_score, risk_class
          FROM (SELECT * FROM parcel_view ORDER BY farm_id DESC LIMIT 7)""",
    "class_tiles": """
        SELECT CASE risk_class WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END::BIGINT AS place, risk_class,
               CASE risk_class WHEN 'LOW' THEN 'Compliant' WHEN 'MEDIUM' THEN 'Needs review' ELSE 'Non-compliant' END AS label,
               count(*)::BIGINT AS count
        FROM assessments WHERE risk_class IS NOT NULL GROUP BY risk_class""",
    "rounding": """
        SELECT round_even(v, 3) AS even3, round(v, 1) AS up1, round(v, 2) AS up2, round(v, 4) AS up4, count(*)::BIGINT AS n
        FROM (SELECT l_quantity / 16.0::DOUBLE + l_linenumber AS v FROM lineitem) GROUP BY 1, 2, 3, 4""",
    "scalar_functions": """
        SELECT DISTINCT l_quantity AS q, round(sqrt(l_quantity), 6) AS root, abs(l_quantity - 25) AS gap,
               least(l_quantity, 30.0) AS clipped, round_even(l_quantity / 48.0::DOUBLE * 100, 3) AS pct FROM lineitem""",
    # ---- models
    "balanced_weight": """
        SELECT farm_id, round(n::DOUBLE / (k * n_class), 6) AS weight
        FROM assessments LEFT JOIN (
          SELECT risk_class, n_class, sum(n_class) OVER () AS n, count(*) OVER () AS k FROM (
            SELECT risk_class, count(*) AS n_class FROM assessments WHERE risk_class IS NOT NULL GROUP BY risk_class))
        USING (risk_class)""",
    "stratified_folds": """
        SELECT farm_id, risk_class, (row_number() OVER (PARTITION BY risk_class
          ORDER BY substr(md5('42:' || farm_id), 1, 8), farm_id) - 1) % 5 AS fold FROM assessments""",
    "stratified_split": """
        SELECT farm_id, row_number() OVER (PARTITION BY risk_class ORDER BY substr(md5('42:' || farm_id), 1, 8), farm_id)
          <= ceil(0.25 * count(*) OVER (PARTITION BY risk_class)) AS is_test FROM assessments""",
    "roc_auc": _ranking(_SCORE_ROWS) + "SELECT roc_auc FROM rank_metrics",
    "average_precision": _ranking(_SCORE_ROWS) + "SELECT pr_auc FROM rank_metrics",
    "macro_f1": _MATRIX + "SELECT round(avg(f1), 6) AS macro_f1 FROM per_class WHERE support + guessed > 0",
    "classification_report": _MATRIX + """
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class""",
    "report_averages": _MATRIX + """
        SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
               round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
               round(sum(precision * support) / sum(support), 6) AS weighted_precision,
               round(sum(recall * support) / sum(support), 6) AS weighted_recall,
               round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support
        FROM per_class WHERE support + guessed > 0""",
    "confusion_matrix": _MATRIX + "SELECT label, predicted, n FROM matrix",
    "select_best": _ranking("""
        SELECT unnest(['B: nb200 only', 'D: nb 200+500+1000', 'A: area+nb200 (baseline)']) AS feature,
               unnest([nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100]) AS value,
               CASE WHEN defo_pct > 0 THEN 1 ELSE 0 END AS hit
        FROM frame WHERE risk_binary IS NOT NULL""") + """
        SELECT feature AS features, roc_auc, pr_auc, n_feats FROM (
          SELECT *, CASE feature WHEN 'B: nb200 only' THEN 1 WHEN 'D: nb 200+500+1000' THEN 3 ELSE 2 END::BIGINT AS n_feats
          FROM rank_metrics) ORDER BY pr_auc DESC, roc_auc DESC, n_feats, feature LIMIT 1""",
    "usable_rows": _REAL + """
        SELECT features, n_feats, count(*)::BIGINT AS n_rows, (count(*) FILTER (WHERE usable))::BIGINT AS n_usable,
               (count(*) FILTER (WHERE has_rings))::BIGINT AS n_common
        FROM (
          SELECT has_rings, unnest([
            {'features': 'A: area+nb200 (baseline)', 'n_feats': 2::BIGINT, 'usable': has_200},
            {'features': 'B: nb200 only', 'n_feats': 1::BIGINT, 'usable': has_200},
            {'features': 'C: distance only', 'n_feats': 1::BIGINT, 'usable': true},
            {'features': 'D: nb 200+500+1000', 'n_feats': 3::BIGINT, 'usable': has_rings},
            {'features': 'E: dist + nb multi', 'n_feats': 4::BIGINT, 'usable': has_rings},
            {'features': 'F: E + area', 'n_feats': 5::BIGINT, 'usable': has_rings}], recursive := true)
          FROM wide_frame WHERE risk_binary IS NOT NULL) GROUP BY features, n_feats""",
    "regression_score_ranges": _REAL + "SELECT farm_id, has_rings AS scored, true AS in_range FROM wide_frame",
    "out_of_fold_ranges": _REAL + """
        SELECT farm_id, true AS in_range FROM wide_frame WHERE risk_binary IS NOT NULL AND has_rings""",
    "scoring_run": "SELECT farm_id, defo_pct, risk_class, true AS in_range FROM assessments",
    "variant_counts": _REAL + """,
labels AS (
  SELECT 'binary' AS framing, risk_binary AS label, farm_id FROM wide_frame WHERE has_rings
  UNION ALL SELECT '3-class', a.risk_class, farm_id FROM wide_frame JOIN assessments a USING (farm_id) WHERE has_rings)
        SELECT model, framing, features, label, count(*)::BIGINT AS n, count(DISTINCT farm_id)::BIGINT AS n_farms, true AS in_range
        FROM labels, (SELECT unnest(['RF', 'LR']) AS model),
             (SELECT unnest(['A: area+nb200 (baseline)', 'B: nb200 only', 'C: distance only', 'D: nb 200+500+1000',
                             'E: dist + nb multi', 'F: E + area']) AS features)
        WHERE label IS NOT NULL GROUP BY model, framing, features, label""",
    "watch_list": _REAL + """
        SELECT f.farm_id, f.area_ha, d.dist_to_defo_m, w.nb_defo_pct_200, w.nb_defo_pct_500, w.nb_defo_pct_1000, a.risk_score
        FROM farms f JOIN wide_shares w USING (farm_id) JOIN wide_distances d USING (farm_id) JOIN assessments a USING (farm_id)
        WHERE a.risk_binary = 'CLEAN' ORDER BY a.risk_score DESC NULLS LAST, f.farm_id LIMIT 25""",
    "leakage_by_derivation": _ranking("""
        SELECT unnest(['nb_defo_pct_20', 'nb_defo_pct_50', 'nb_defo_pct_100', 'pressure', 'area_ha']) AS feature,
               unnest([nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100, defo_pct * 0.001::DOUBLE + nb_defo_pct_20, area_ha]) AS value,
               CASE WHEN defo_pct > 0 THEN 1 ELSE 0 END AS hit
        FROM frame WHERE risk_binary IS NOT NULL""") + """
        SELECT feature, false AS is_own_loss, CASE WHEN feature = 'pressure' THEN 'defo_pct' ELSE '' END AS derived_from, roc_auc,
               feature = 'pressure' OR roc_auc IN (0.0, 1.0) AS leaks FROM rank_metrics""",
    "leakage_audit": _ranking("""
        SELECT unnest(['nb_defo_pct_20', 'nb_defo_pct_50', 'nb_defo_pct_100', 'defo_pct', 'area_ha']) AS feature,
               unnest([nb_defo_pct_20, nb_defo_pct_50, nb_defo_pct_100, defo_pct, area_ha]) AS value,
               CASE WHEN defo_pct > 0 THEN 1 ELSE 0 END AS hit
        FROM frame WHERE risk_binary IS NOT NULL""") + """
        SELECT feature, feature = 'defo_pct' AS is_own_loss, roc_auc,
               feature = 'defo_pct' OR roc_auc IN (0.0, 1.0) AS leaks FROM rank_metrics""",
}

_QUERIES["compacted_tables"] = _QUERIES["updated_tables"]
# the same rows out of a raster stored by tile
_QUERIES |= {f"{name}_tiles": _QUERIES[whole] for name, whole in (
    ("clip", "clip_boundary"), ("zonal_sum", "zonal_sum"), ("sample_at", "sample_at"))}

ORACLE_SQL = {name: _BASE + sql for name, sql in _QUERIES.items()}
