"""X: served tables. V: validation. Q: lookups over the served tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcell.catalog.inputs import (SPLITS, background, boroughs, lots, neighbours, panel, scored, spine, starts, table, train_sums,
                                     with_sql)
from weekcell.catalog.registry import query
from weekcell.catalog.stages import scratch, staged
from weekcell.catalog.times import DAILY, daily
from weekcell.functions import geo
from weekcell.functions.predicates import LANE_TYPES
from weekcell.operators.panel import slot_sums
from weekcell.plans import level, serving as sv

MONTH, AS_OF = "2000-01", "1999-12-20"

# the served table, spelled out: shrunk training rate x level factor, reporting index, 12-month history
SERVED = """, grid AS (SELECT cell, h AS hour_of_week FROM (SELECT DISTINCT cell FROM panel), (SELECT CAST(unnest(range(168)) AS INTEGER) AS h)),
tr AS (SELECT cell, hour_of_week, (sum(y) + 0.5::DOUBLE) / (sum(exposure) + 100.0::DOUBLE) AS mu FROM panel WHERE month BETWEEN '1995-01' AND '1998-12' GROUP BY ALL),
lf AS (SELECT DATE '1999-10-24' AS window_start, DATE '1999-12-18' AS window_end, sum(observed) AS observed, sum(predicted) AS predicted, sum(observed) / sum(predicted) AS factor FROM daily WHERE day BETWEEN DATE '1999-10-24' AND DATE '1999-12-18'),
sees AS (SELECT cell AS me, neighbour AS cell FROM nbr UNION SELECT neighbour, cell FROM nbr UNION SELECT DISTINCT cell, cell FROM panel),
raw AS (SELECT c.cell, coalesce(sum(n), 0)::DOUBLE AS value FROM (SELECT DISTINCT cell FROM panel) c LEFT JOIN sees ON sees.me = c.cell
  LEFT JOIN bg ON bg.cell = sees.cell AND bg.month BETWEEN '1999-01' AND '1999-12' GROUP BY c.cell),
r1 AS (SELECT cell, value / (SELECT quantile_cont(value, 0.5) FROM raw) AS r FROM raw),
idx AS (SELECT cell, greatest(r, (SELECT quantile_cont(r, 0.05) FROM r1)) AS propensity_index FROM r1),
hist AS (SELECT cell, hour_of_week, coalesce(y / e, 0) AS historical, coalesce(e, 0)::DOUBLE AS historical_hours FROM grid LEFT JOIN (
  SELECT cell, hour_of_week, sum(y)::DOUBLE AS y, sum(exposure) AS e FROM panel WHERE month BETWEEN '1999-01' AND '1999-12' GROUP BY ALL) USING (cell, hour_of_week)),
preds AS (SELECT cell, hour_of_week, mu * factor AS predicted, mu * factor / propensity_index AS adjusted, historical, historical_hours
  FROM tr JOIN idx USING (cell) JOIN hist USING (cell, hour_of_week), lf)
"""
BASE = with_sql("panel", "scored", "ord", "bg", "nbr") + DAILY + SERVED
INPUTS = with_sql("panel", "scored", "ord", "bg", "boro", "lots", "nbr") + DAILY + SERVED


def index(spark, d):
    return staged(spark, d, "index", lambda: build_index(spark, d), ["cell"])


def build_index(spark, d):
    own = neighbours(spark, d)
    both = own.unionByName(own.select(F.col("neighbour").alias("cell"), F.col("cell").alias("neighbour"))).distinct()
    return sv.reporting_index(sv.trailing_background(background(spark, d), both, spine(spark, d), MONTH))


def factor(spark, d):
    return level.factor_as_of(daily(spark, d), AS_OF)


def history(spark, d):
    year = F.col("month").between("1999-01", "1999-12")  # the twelve months before MONTH
    return sv.historical_of(spine(spark, d), slot_sums(spine(spark, d).where(year), starts(spark, d).where(year)))


def served(spark, d):
    return staged(spark, d, "served", lambda: build_served(spark, d), ["hour_of_week", "cell"])


def build_served(spark, d):
    rate = train_sums(spark, d).select("cell", "hour_of_week", ((F.col("y") + 0.5) / (F.col("exposure") + 100.0)).alias("mu"))
    return sv.serve_predictions(rate, factor(spark, d).select("factor").scalar(), index(spark, d), history(spark, d))


def rounded(df, *cols, places=8):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("X1_served_table", BASE + "SELECT cell, hour_of_week, round(predicted, 8) AS predicted, round(adjusted, 8) AS adjusted, round(historical, 8) AS historical, historical_hours FROM preds")
def _(spark, d):
    return rounded(build_served(spark, d), *sv.LAYERS)


@query("X2_level_as_of", BASE + "SELECT window_start, window_end, observed, round(predicted, 6) AS predicted, round(factor, 9) AS factor FROM lf")
def _(spark, d):
    return factor(spark, d).withColumn("predicted", F.round("predicted", 6)).withColumn("factor", F.round("factor", 9))


# days of the served month itself, by the rates that are about to be served
SERVING_DAYS = """, srv AS (SELECT cell, month, hour_of_week, exposure, exposure * mu AS mu FROM panel JOIN tr USING (cell, hour_of_week) WHERE month = '2000-01'),
both_ AS (SELECT cell, month, hour_of_week, exposure, mu FROM scored UNION ALL SELECT cell, month, hour_of_week, exposure, mu FROM srv),
brate AS (SELECT month, hour_of_week // 24 AS dow, sum(mu / exposure) AS predicted FROM both_ WHERE exposure > 0 GROUP BY ALL),
bobs AS (SELECT CAST(ts AS DATE) AS day, count(*) AS observed FROM ord WHERE (cell, month) IN (SELECT (cell, month) FROM both_) GROUP BY ALL),
bdays AS (SELECT day, coalesce(observed, 0)::DOUBLE AS observed, predicted FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2000-01-31', INTERVAL 1 DAY)) AS DATE) AS day)
  JOIN brate ON month = strftime(day, '%Y-%m') AND dow = isodow(day) - 1 LEFT JOIN bobs USING (day))
"""
AS_OF_DAYS = ["1999-12-31", "2000-01-02", "2000-01-03", "2000-01-20", "2000-02-02"]


@query("X2_window_into_month", BASE + SERVING_DAYS + "SELECT as_of, min(day) AS window_start, max(day) AS window_end, sum(observed) AS observed, round(sum(predicted), 6) AS predicted, round(sum(observed) / sum(predicted), 9) AS factor FROM (VALUES "
       + ", ".join(f"('{x}')" for x in AS_OF_DAYS) + ") v(as_of) JOIN bdays ON day BETWEEN CAST(as_of AS DATE) - 57 AND CAST(as_of AS DATE) - 2 GROUP BY as_of")
def _(spark, d):
    # windows that end before the served month, on its first days, within it and on its last day
    p = panel(spark, d)
    rate = p.where(F.col("month").between(*SPLITS["train"])).groupBy("cell", "hour_of_week").agg(
        ((F.sum("y") + 0.5) / (F.sum("exposure") + 100.0)).alias("rate"))
    serving = p.where(F.col("month") == MONTH).join(rate, ["cell", "hour_of_week"]).withColumn("mu", F.col("exposure") * F.col("rate"))
    out = None
    for as_of in AS_OF_DAYS:
        one = level.serving_factor(scored(spark, d), serving, starts(spark, d), MONTH, as_of).select(
            F.lit(as_of).alias("as_of"), "window_start", "window_end", "observed", F.round("predicted", 6).alias("predicted"), F.round("factor", 9).alias("factor"))
        out = one if out is None else out.unionByName(one)
    return out


@query("X3_reporting_index", BASE + "SELECT cell, round(propensity_index, 9) AS propensity_index FROM idx")
def _(spark, d):
    return rounded(build_index(spark, d), "propensity_index", places=9)


@query("X4_historical_rates", BASE + "SELECT cell, hour_of_week, round(historical, 9) AS historical, historical_hours FROM hist")
def _(spark, d):
    return rounded(history(spark, d), "historical", places=9)


def lane_table(spark, d):
    """Lane metres of every cell, from the lots' numbers."""
    sums = lots(spark, d).groupBy("cell").agg(*[F.round(F.sum(c), 2).alias(c) for c in ("lotfront", "comarea")])
    f, c = F.col("lotfront"), F.col("comarea")
    lanes = dict(zip(LANE_TYPES, (f, c, f * 0.5, f * 0)))
    return (boroughs(spark, d).join(sums, "cell").select(
        "cell", "boro", *[v.alias(f"lane_m_{t}") for t, v in lanes.items()], (f * 1.5 + c).alias("lane_m_total")))


LANES = """, lt AS (SELECT cell, boro, lotfront AS lane_m_protected, comarea AS lane_m_curbside, lotfront * 0.5::DOUBLE AS lane_m_buffered, lotfront * 0 AS lane_m_conventional, lotfront * 1.5::DOUBLE + comarea AS lane_m_total
  FROM boro JOIN (SELECT cell, round(sum(lotfront), 2) AS lotfront, round(sum(comarea), 2) AS comarea FROM lots GROUP BY cell) USING (cell)),
names AS (SELECT * FROM (VALUES ('1', 'Manhattan'), ('2', 'Bronx'), ('3', 'Brooklyn'), ('4', 'Queens'), ('5', 'Staten Island')) v(boro, borough)),
wk AS (SELECT cell, sum(predicted) AS p, sum(adjusted) AS a, sum(historical) AS h FROM preds GROUP BY cell)
"""


@query("X5_cell_rollup", INPUTS + LANES + """SELECT cell, borough, round(p, 7) AS predicted_weekly, round(a, 7) AS adjusted_weekly, round(h, 7) AS historical_weekly,
  lane_m_protected, lane_m_curbside, lane_m_buffered, lane_m_conventional, lane_m_total, round(propensity_index, 9) AS propensity_index
FROM wk LEFT JOIN lt USING (cell) LEFT JOIN names USING (boro) LEFT JOIN idx USING (cell)""")
def _(spark, d):
    t = sv.cell_table(served(spark, d), lane_table(spark, d), index(spark, d)).drop("lat", "lng")
    return rounded(rounded(t, *[f"{c}_weekly" for c in sv.LAYERS], places=7), "propensity_index", places=9)


QUANTILES = "[0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995]"


@query("X6_scale_edges", BASE + f"SELECT [round(q, 8) FOR q IN quantile_cont(adjusted, {QUANTILES})] AS edges FROM preds WHERE adjusted > 0")
def _(spark, d):
    return sv.scale_edges(served(spark, d), "adjusted").select(F.transform("edges", lambda v: F.round(v, 8)).alias("edges"))


@query("X7_latest_pull_date", "SELECT CAST((max(o_orderdate + to_hours(CAST(o_orderkey % 6 AS INTEGER))) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS pull_date FROM orders")
def _(spark, d):
    pulled = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 6).cast("int"))
    return sv.latest_pull_date(table(spark, d, "orders").select(pulled.alias("pulled_at")))


@query("X8_metadata", INPUTS + """SELECT '2000-01' AS month, 'shrunk-rate' AS variant, round(factor, 9) AS factor, window_end, '2001-05' AS trips_through, (SELECT count(DISTINCT cell) FROM preds) AS cells, 168 AS slots,
  (SELECT [round(q, 8) FOR q IN quantile_cont(predicted, """ + QUANTILES + """)] FROM preds WHERE predicted > 0) AS predicted_edges, (SELECT count(*) FROM (SELECT cell FROM lots EXCEPT SELECT cell FROM panel)) AS off_network_land_cells FROM lf""")
def _(spark, d):
    preds = served(spark, d)
    cells = spine(spark, d).select("cell").distinct()
    land = lots(spark, d).select("cell").distinct().join(cells, "cell", "left_anti")
    m = sv.metadata(preds, cells, land, MONTH, {"variant": "shrunk-rate"}, factor(spark, d), "2001-05")
    return m.select("month", F.col("model.variant").alias("variant"), F.round("recalibration.factor", 9).alias("factor"),
                    F.col("recalibration.window_end").alias("window_end"), "trips_through", "cells", "slots",
                    F.transform("scale.predicted", lambda v: F.round(v, 8)).alias("predicted_edges"), "off_network_land_cells")


# a damaged copy of the served table: lost slots, doubled slots, bad numbers, a missing and a foreign cell
BROKEN = """, n AS (SELECT *, CAST(substr(cell, 2) AS BIGINT) AS k FROM preds),
bad AS (SELECT CASE WHEN k = 9 THEN 'zz' ELSE cell END AS cell, CASE WHEN k = 3 AND hour_of_week = 7 THEN 8 ELSE hour_of_week END AS hour_of_week,
  CASE WHEN k = 4 AND hour_of_week = 5 THEN 'NaN'::DOUBLE ELSE predicted END AS predicted, CASE WHEN k = 5 AND hour_of_week = 0 THEN 'inf'::DOUBLE ELSE adjusted END AS adjusted,
  CASE WHEN k = 6 AND hour_of_week = 1 THEN -0.1 ELSE historical END AS historical, historical_hours FROM n WHERE NOT (k = 2 AND hour_of_week = 100)),
per AS (SELECT cell, count(*) AS n, count(DISTINCT hour_of_week) AS u, min(hour_of_week) AS lo, max(hour_of_week) AS hi, bool_or(isnan(predicted)) AS np, bool_or(isinf(adjusted)) AS ia, bool_or(historical < 0) AS nh FROM bad GROUP BY cell)
"""


@query("V1_validation", BASE + BROKEN + """SELECT cell, 'not 168 distinct slots' AS problem FROM per WHERE n <> 168 OR u <> 168 OR lo <> 0 OR hi <> 167
UNION ALL SELECT cell, 'NaN or infinite predicted' FROM per WHERE np UNION ALL SELECT cell, 'NaN or infinite adjusted' FROM per WHERE ia UNION ALL SELECT cell, 'negative historical' FROM per WHERE nh
UNION ALL SELECT DISTINCT cell, 'missing cell' FROM panel WHERE cell NOT IN (SELECT cell FROM per) UNION ALL SELECT cell, 'unexpected cell' FROM per WHERE cell NOT IN (SELECT cell FROM panel)""")
def _(spark, d):
    k = F.substring("cell", 2, 20).cast("bigint")
    h = F.col("hour_of_week")
    p = served(spark, d).withColumn("k", k)
    hit = lambda cell, slot: (F.col("k") == cell) & (h == slot)
    bad = p.where(~hit(2, 100)).select(
        F.when(F.col("k") == 9, "zz").otherwise(F.col("cell")).alias("cell"), F.when(hit(3, 7), 8).otherwise(h).alias("hour_of_week"),
        F.when(hit(4, 5), float("nan")).otherwise(F.col("predicted")).alias("predicted"),
        F.when(hit(5, 0), float("inf")).otherwise(F.col("adjusted")).alias("adjusted"),
        F.when(hit(6, 1), -0.1).otherwise(F.col("historical")).alias("historical"), "historical_hours")
    return sv.violations(bad, spine(spark, d))


@query("Q1_slot_query", BASE + """SELECT cell, 56 AS hour_of_week, 'Wed' AS day, 8 AS "hour", 'predicted' AS layer, round(predicted, 8) AS value, round(max(predicted) OVER (), 8) AS max_value FROM preds WHERE hour_of_week = 56""")
def _(spark, d):
    slot = sv.resolve_slot(spark, day="wednesday", hour=8)
    return rounded(sv.slot_query(served(spark, d), slot), "value", "max_value")


@query("Q2_cell_detail", INPUTS + LANES + """SELECT cell, borough, round(lane_m_protected, 1) AS lane_m_protected, CASE WHEN lane_m_total > 0 THEN round(lane_m_curbside / lane_m_total, 3) ELSE 0 END AS lane_share_curbside,
  s.series AS predicted_series, s.hours AS historical_hours, round(p, 7) AS predicted_weekly FROM wk JOIN lt USING (cell) JOIN names USING (boro)
  JOIN (SELECT cell, list(round(predicted, 6) ORDER BY hour_of_week) AS series, list(historical_hours ORDER BY hour_of_week) AS hours FROM preds GROUP BY cell) s USING (cell)""")
def _(spark, d):
    preds = served(spark, d)
    cells = sv.cell_table(preds, lane_table(spark, d), index(spark, d))
    detail = sv.cell_detail(cells, preds)
    return detail.select("cell", "borough", "lane_m_protected", "lane_share_curbside", "predicted_series", "historical_hours",
                         F.round("predicted_weekly", 7).alias("predicted_weekly"))


@query("Q3_grid_listing", with_sql("lots", "spine") + "SELECT DISTINCT cell, 'network' AS kind FROM spine UNION ALL SELECT DISTINCT cell, 'off_network' FROM lots WHERE cell NOT IN (SELECT cell FROM spine)")
def _(spark, d):
    cells = spine(spark, d).select("cell").distinct()
    land = lots(spark, d).select("cell").distinct().join(cells, "cell", "left_anti")
    return sv.grid_listing(cells, land)


@query("W13_guarded_write", BASE + "SELECT count(*) AS slots, count(DISTINCT cell) AS cells, 1::BIGINT AS metadata_rows FROM preds")
def _(spark, d):
    folder = scratch(spark, "served")
    preds = served(spark, d)
    cells = spine(spark, d).select("cell").distinct()
    meta = sv.metadata(preds, cells, cells.limit(0), MONTH, {"variant": "shrunk-rate"}, factor(spark, d), "2001-05")
    sv.write_artifact(sv.Artifact(preds, cells, cells.limit(0), meta), folder)
    back = spark.read.parquet(f"{folder}/predictions")
    lines = spark.read.text(f"{folder}/meta").agg(F.count("*").alias("n"))
    return back.agg(F.count("*").alias("slots"), F.count_distinct("cell").alias("cells")).withColumn("metadata_rows", lines.scalar())


@query("H4_cell_centre_roundtrip", """SELECT user_id, true AS same_cell FROM (SELECT DISTINCT user_id FROM events)""")
def _(spark, d):
    # a cell's centre, sent to degrees and back, falls in the cell again
    ids = table(spark, d, "events").select("user_id").distinct()
    cells = ids.withColumn("cell", geo.cell_id(F.col("user_id") % 40 + 1500, F.col("user_id") % 31 + 15000))
    cx, cy = geo.cell_centre("cell")
    placed = cells.withColumn("cx", cx).withColumn("cy", cy)
    lon, lat = geo.to_lonlat("cx", "cy")
    deg = placed.withColumn("lon", lon).withColumn("lat", lat)
    x, y = geo.to_metric("lon", "lat")
    back = deg.withColumn("x", x).withColumn("y", y).withColumn("again", geo.point_cell("x", "y"))
    return back.select("user_id", (F.col("again") == F.col("cell")).alias("same_cell"))
