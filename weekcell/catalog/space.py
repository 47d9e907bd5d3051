"""H: spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcell.catalog.inputs import background, events, lots, scoped_segments, segments, spine, with_sql
from weekcell.catalog.registry import query
from weekcell.functions import geo
from weekcell.operators import spatial

EDGE = geo.HEX_EDGE_M
# Axial hexagon of a metric point, spelled out
HEX = """(SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE
    CAST(CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END AS BIGINT) || ':' ||
    CAST(CASE WHEN dq > dr AND dq > ds THEN r WHEN dr > ds THEN -q - s ELSE r END AS BIGINT) END AS hexcell
  FROM (SELECT *, abs(q - fq) AS dq, abs(r - fr) AS dr, abs(s - fs) AS ds
  FROM (SELECT *, floor(fq + 0.5) AS q, floor(fr + 0.5) AS r, floor(fs + 0.5) AS s
  FROM (SELECT *, -fq - fr AS fs FROM (SELECT *, (1.7320508075688772::DOUBLE / 3 * x - y / 3) / 200.0::DOUBLE AS fq, (2.0::DOUBLE / 3 * y) / 200.0::DOUBLE AS fr FROM {src})))))"""


def hexed(spark, d):
    return spatial.with_cell(events(spark, d), name="hexcell")


def _series_sql() -> str:
    """Transverse Mercator of (lat, lon) with the engine's constants, as SQL."""
    e = 2 * geo._N ** 0.5 / (1 + geo._N)
    x = "eta" + "".join(f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    y = "xi" + "".join(f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    k = geo.UTM_K0 * geo._RECT_A
    return f"""(SELECT *, 500000.0::DOUBLE + {k!r}::DOUBLE * ({x}) AS mx, {k!r}::DOUBLE * ({y}) AS my
      FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta
      FROM (SELECT *, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t
      FROM (SELECT *, radians(lat) AS phi, radians(lon + 75.0::DOUBLE) AS lam FROM ev))))"""


@query("H1_project", with_sql("ev") + f"SELECT event_id, round(mx, 2) AS mx, round(my, 2) AS my FROM {_series_sql()}")
def _(spark, d):
    m = spatial.with_metric(events(spark, d), "lon", "lat", "mx", "my")
    return m.select("event_id", F.round("mx", 2).alias("mx"), F.round("my", 2).alias("my"))


@query("H2_point_cell", with_sql("ev") + "SELECT event_id, hexcell FROM " + HEX.format(src="ev"))
def _(spark, d):
    return hexed(spark, d).select("event_id", "hexcell")


RING_SQL = "(VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) o(dq, dr)"


@query("H3_ring_counts", with_sql("ev") + ", h AS (SELECT hexcell, count(*) AS n FROM " + HEX.format(src="ev") + f""" WHERE hexcell IS NOT NULL GROUP BY 1),
a AS (SELECT CAST(split_part(hexcell, ':', 1) AS BIGINT) AS q, CAST(split_part(hexcell, ':', 2) AS BIGINT) AS r, n FROM h)
SELECT (q + dq) || ':' || (r + dr) AS cell, CAST(sum(n) AS BIGINT) AS n FROM a, {RING_SQL} GROUP BY ALL""")
def _(spark, d):
    from weekcell.operators.trailing import ring_sum
    counts = hexed(spark, d).where(F.col("hexcell").isNotNull()).groupBy(F.col("hexcell").alias("cell")).agg(F.count("*").alias("n"))
    return ring_sum(counts, "n", include_self=False)


@query("H4_cell_shape", with_sql("ev") + ", h AS (SELECT DISTINCT hexcell FROM " + HEX.format(src="ev") + """ WHERE hexcell IS NOT NULL),
a AS (SELECT hexcell, CAST(split_part(hexcell, ':', 1) AS BIGINT) AS q, CAST(split_part(hexcell, ':', 2) AS BIGINT) AS r FROM h)
SELECT hexcell AS cell, round(200.0::DOUBLE * (1.7320508075688772::DOUBLE * q + 1.7320508075688772::DOUBLE / 2 * r), 3) AS cx, round(200.0::DOUBLE * 1.5::DOUBLE * r, 3) AS cy,
  6 AS corners, round(200.0::DOUBLE * (1.7320508075688772::DOUBLE * q + 1.7320508075688772::DOUBLE / 2 * r) + 200.0::DOUBLE * cos(radians(30)), 3) AS x_right FROM a""")
def _(spark, d):
    cells = hexed(spark, d).where(F.col("hexcell").isNotNull()).select(F.col("hexcell").alias("cell")).distinct()
    cx, cy = geo.cell_centre("cell")
    corners = cells.withColumn("_c", geo.cell_corners("cell"))
    return corners.select("cell", F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"), F.size("_c").alias("corners"),
                          F.round(F.array_max(F.transform("_c", lambda c: c["x"])), 3).alias("x_right"))


def pieces(spark, d, dense=False):
    return segments(spark, d, dense).select("segment_id", "x0", "y0", "x1", "y1")


# Every hexagon of the bounding box against every line, clipped by three strips: brute force
CLIP = """, box AS (SELECT CAST(floor(min(least(x0, x1)) / 346.0) - 2 AS BIGINT) AS a0, CAST(ceil(max(greatest(x0, x1)) / 346.0) + 2 AS BIGINT) AS a1,
  CAST(floor(min(least(y0, y1)) / 300.0) - 2 AS BIGINT) AS b0, CAST(ceil(max(greatest(y0, y1)) / 300.0) + 2 AS BIGINT) AS b1 FROM seg),
hexes AS (SELECT a - (r // 2) AS q, r, 200.0::DOUBLE * (1.7320508075688772::DOUBLE * (a - (r // 2)) + 1.7320508075688772::DOUBLE / 2 * r) AS cx, 200.0::DOUBLE * 1.5::DOUBLE * r AS cy
  FROM (SELECT unnest(range(a0, a1 + 1)) AS a, b0, b1 FROM box) p, LATERAL (SELECT unnest(range(p.b0, p.b1 + 1)) AS r) t),
strips AS (SELECT * FROM (VALUES (1.0::DOUBLE, 0.0::DOUBLE), (0.5000000000000001::DOUBLE, 0.8660254037844386::DOUBLE), (-0.4999999999999998::DOUBLE, 0.8660254037844387::DOUBLE)) v(nx, ny)),
spans AS (SELECT segment_id, q || ':' || r AS cell, hypot_len, max(lo) AS t0, min(hi) AS t1 FROM (
  SELECT segment_id, q, r, hypot_len, CASE WHEN abs(st) < 1e-12 THEN CASE WHEN abs(s0) <= 173.20508075688772 THEN 0 ELSE 2 END ELSE greatest(0, least((-173.20508075688772 - s0) / st, (173.20508075688772 - s0) / st)) END AS lo,
    CASE WHEN abs(st) < 1e-12 THEN CASE WHEN abs(s0) <= 173.20508075688772 THEN 1 ELSE -1 END ELSE least(1, greatest((-173.20508075688772 - s0) / st, (173.20508075688772 - s0) / st)) END AS hi
  FROM (SELECT segment_id, q, r, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS hypot_len,
    (x0 - cx) * nx + (y0 - cy) * ny AS s0, (x1 - x0) * nx + (y1 - y0) * ny AS st
    FROM seg JOIN hexes ON cx BETWEEN least(x0, x1) - 201 AND greatest(x0, x1) + 201 AND cy BETWEEN least(y0, y1) - 201 AND greatest(y0, y1) + 201, strips))
  GROUP BY ALL HAVING max(lo) <= min(hi))
"""


@query("H5_line_cells", with_sql("seg") + CLIP + "SELECT segment_id, count(*) AS cells, min(cell) AS first_cell FROM spans GROUP BY segment_id")
def _(spark, d):
    cells = spatial.piece_cells(pieces(spark, d), ["segment_id"])
    return cells.groupBy("segment_id").agg(F.count_distinct("cell").alias("cells"), F.min("cell").alias("first_cell"))


@query("H6_segment_bridge", with_sql("seg") + CLIP + "SELECT segment_id, cell FROM spans SEMI JOIN (SELECT segment_id FROM seg WHERE usable) u USING (segment_id)")
def _(spark, d):
    usable = segments(spark, d).where("usable").select("segment_id", "x0", "y0", "x1", "y1")
    return spatial.segment_cells(usable).select("segment_id", "cell")


@query("H7_length_in_cell", with_sql("seg") + CLIP + "SELECT segment_id, cell, round((t1 - t0) * hypot_len, 4) AS len_m FROM spans")
def _(spark, d):
    return spatial.segment_cells(pieces(spark, d)).select("segment_id", "cell", F.round("len_m", 4).alias("len_m"))


# every point against every line: brute force
NEAR = """, near AS (SELECT * FROM (SELECT *, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) AS dist_m FROM (
  SELECT *, x0 + t * (x1 - x0) AS nx, y0 + t * (y1 - y0) AS ny FROM (
    SELECT e.event_id, e.ts, e.x, e.y, s.*, CASE WHEN (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 THEN
      greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) ELSE 0 END AS t
    FROM ev e, seg s WHERE e.x IS NOT NULL))) WHERE dist_m <= 40)"""


def points(spark, d):
    return events(spark, d, dense=True).select(F.col("event_id").alias("point_id"), "ts", "x", "y")


@query("H8_within_distance", with_sql("ev", "seg", dense=True) + NEAR + "SELECT DISTINCT event_id AS point_id, segment_id, round(dist_m, 6) AS dist_m FROM near")
def _(spark, d):
    # distinct points and distinct lines meet once, so the pairs need no exchange of their own
    each = points(spark, d).select("point_id", "x", "y").distinct()
    near = spatial.within_distance(each, pieces(spark, d, dense=True), salts=4, spread=["point_id"])
    return near.select("point_id", "segment_id", F.round("dist_m", 6).alias("dist_m"))


SNAPPED = NEAR.replace("FROM ev e, seg s WHERE", "FROM ev e, seg s WHERE s.lane_class IN ('I', 'II') AND s.on_street = 'ON' AND") + """,
cand AS (SELECT *, coalesce(usable AND valid_from <= ts AND (valid_to IS NULL OR ts < valid_to), false) AS active, coalesce(usable AND valid_from > ts, false) AS future FROM near),
best AS (SELECT event_id, segment_id, dist_m, nx, ny FROM cand WHERE active QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(dist_m, 9), segment_id) = 1),
allf AS (SELECT event_id, bool_and(future) AS future FROM cand GROUP BY event_id),
snapped AS (SELECT e.event_id AS point_id, e.ts, e.x, e.y, b.segment_id, b.dist_m AS snap_dist_m, b.nx, b.ny,
  CASE WHEN e.x IS NULL THEN 'no_coords' WHEN b.event_id IS NOT NULL THEN NULL WHEN a.event_id IS NULL THEN 'no_lane_within_tol'
       WHEN a.future THEN 'lane_not_installed' ELSE 'lane_not_active' END AS drop_reason
  FROM ev e LEFT JOIN best b USING (event_id) LEFT JOIN allf a USING (event_id))
"""


def snapped(spark, d):
    return spatial.snap(points(spark, d), scoped_segments(spark, d, dense=True))


@query("H9_nearest_valid_segment", with_sql("ev", "seg", dense=True) + SNAPPED + "SELECT point_id, segment_id, round(snap_dist_m, 6) AS snap_dist_m FROM snapped WHERE segment_id IS NOT NULL")
def _(spark, d):
    kept = snapped(spark, d).where(F.col("segment_id").isNotNull())
    return kept.select("point_id", "segment_id", F.round("snap_dist_m", 6).alias("snap_dist_m"))


@query("H10_snapped_cell", with_sql("ev", "seg", dense=True) + SNAPPED + "SELECT point_id, hexcell AS cell FROM " + HEX.format(
    src="(SELECT point_id, nx AS x, ny AS y FROM snapped WHERE segment_id IS NOT NULL)"))
def _(spark, d):
    return snapped(spark, d).where(F.col("cell").isNotNull()).select("point_id", "cell")


@query("H11_drop_reasons", with_sql("ev", "seg", dense=True) + SNAPPED + "SELECT point_id, drop_reason FROM snapped")
def _(spark, d):
    return snapped(spark, d).select("point_id", "drop_reason")


STATS = """SELECT count(*) AS points, count(*) FILTER (drop_reason IS NULL) AS kept, count(drop_reason) AS dropped, round(count(drop_reason) / count(*)::DOUBLE, 4) AS dropped_fraction,
  count(*) FILTER (drop_reason = 'no_coords') AS drop_no_coords, count(*) FILTER (drop_reason = 'no_lane_within_tol') AS drop_no_lane_within_tol,
  count(*) FILTER (drop_reason = 'lane_not_installed') AS drop_lane_not_installed, count(*) FILTER (drop_reason = 'lane_not_active') AS drop_lane_not_active,
  count(*) FILTER (near_cell <> raw_cell) AS kept_moved_cell FROM """


@query("H12_drop_stats", with_sql("ev", "seg", dense=True) + SNAPPED + STATS + "(SELECT s.*, h.hexcell AS near_cell, g.hexcell AS raw_cell FROM snapped s LEFT JOIN (SELECT point_id, hexcell FROM "
       + HEX.format(src="(SELECT point_id, nx AS x, ny AS y FROM snapped)") + ") h USING (point_id) LEFT JOIN (SELECT point_id, hexcell FROM "
       + HEX.format(src="(SELECT point_id, x, y FROM snapped)") + ") g USING (point_id))")
def _(spark, d):
    return spatial.drop_stats(snapped(spark, d))


@query("H13_cells_on_segments", with_sql("ev", "seg", dense=True) + SNAPPED + "SELECT count(*) AS kept, 0::BIGINT AS off_segment FROM snapped WHERE segment_id IS NOT NULL")
def _(spark, d):
    snap = snapped(spark, d).where(F.col("cell").isNotNull())
    bridge = spatial.segment_cells(scoped_segments(spark, d, dense=True).select("segment_id", "x0", "y0", "x1", "y1"))
    off = spatial.cells_off_segment(snap, bridge).agg(F.count("*").alias("n"))
    return snap.agg(F.count("*").alias("kept")).withColumn("off_segment", off.scalar())


@query("H14_grid_to_cells", with_sql("ev") + ", g AS (SELECT '2024-01' AS month, count(*) AS n, round(round(lat / 0.002::DOUBLE) * 0.002::DOUBLE, 3) AS lat, "
       "round(round(lon / 0.002::DOUBLE) * 0.002::DOUBLE, 3) AS lon FROM ev WHERE lat IS NOT NULL GROUP BY ALL) SELECT hexcell AS cell, month, CAST(sum(n) AS BIGINT) AS n FROM "
       + HEX.format(src="(SELECT month, n, mx AS x, my AS y FROM " + _series_sql().replace("FROM ev)", "FROM g)") + ")") + " GROUP BY ALL")
def _(spark, d):
    grid = events(spark, d).groupBy(geo.snap_grid("lat").alias("grid_lat"), geo.snap_grid("lon").alias("grid_lon")).agg(
        F.count("*").alias("n")).withColumn("month", F.lit("2024-01"))
    return spatial.grid_counts_to_cells(grid)


@query("H15_cells_without_network", with_sql("lots", "spine", "bg") + """
SELECT DISTINCT cell FROM (SELECT cell FROM lots UNION ALL SELECT cell FROM bg) WHERE cell NOT IN (SELECT cell FROM spine)""")
def _(spark, d):
    land = lots(spark, d).select("cell").unionByName(background(spark, d).select("cell"))
    return spatial.cells_without_network(land, spine(spark, d))
