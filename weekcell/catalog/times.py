"""I: event and time-series operators. N: windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcell.catalog.inputs import (events, months, orders, scored, spine, table, trips, with_sql)
from weekcell.catalog.registry import query
from weekcell.catalog.relational import CHANGES
from weekcell.functions.calendar import month_label
from weekcell.operators import incidents as inc, panel as pan, trailing
from weekcell.operators.scale import global_running_sum
from weekcell.plans import level, profile
from weekcell.plans.evaluate import equal_bins

ANCHORED = with_sql("ev", "anchors", "inc", recursive=True)


@query("I1_anchored_sessions", ANCHORED + """SELECT e.event_id, a.start AS incident_start FROM ev e JOIN anchors a
ON a.cell = e.cell AND e.ts >= a.start AND e.ts <= a.start + INTERVAL 15 MINUTE""")
def _(spark, d):
    return inc.assign_incidents(events(spark, d)).select("event_id", "incident_start")


@query("I2_chained_sessions", with_sql("ev") + """SELECT event_id, max(o) OVER (PARTITION BY cell ORDER BY ts) AS session_start FROM (
  SELECT *, CASE WHEN p IS NULL OR ts > p + INTERVAL 15 MINUTE THEN ts END AS o FROM (SELECT *, lag(ts) OVER (PARTITION BY cell ORDER BY ts) AS p FROM ev))""")
def _(spark, d):
    return inc.chained_sessions(events(spark, d)).select("event_id", "session_start")


@query("I3_incident_table", ANCHORED + "SELECT cell, start, month, hour_of_week, n_events FROM inc")
def _(spark, d):
    t = inc.incident_table(events(spark, d))
    return t.withColumn("hour_of_week", F.col("hour_of_week").cast("int"))


@query("I3_one_cell", """WITH RECURSIVE anchors AS (SELECT min(ts) AS start FROM events
  UNION ALL SELECT (SELECT min(ts) FROM events WHERE ts > start + INTERVAL 15 MINUTE) FROM anchors WHERE start IS NOT NULL)
SELECT 'all' AS cell, start, count(*) AS n_events FROM anchors JOIN events ON ts >= start AND ts <= start + INTERVAL 15 MINUTE GROUP BY start""")
def _(spark, d):
    # every event in the same cell: its windows still open in parallel
    return inc.anchored_incidents(table(spark, d, "events").select(F.lit("all").alias("cell"), "ts"))


@query("I4_exposure", with_sql("expo") + "SELECT month, hour_of_week, exposure FROM expo")
def _(spark, d):
    e = pan.exposure_calendar(months(spark, d))
    return e.select("month", F.col("hour_of_week").cast("int").alias("hour_of_week"), F.col("exposure").cast("int").alias("exposure"))


EV_PANEL = """, evnet AS (SELECT DISTINCT cell, strftime(ts, '%Y-%m') AS month FROM ev WHERE event_type <> 'error'),
hours AS (SELECT m AS month, CAST((isodow(l) - 1) * 24 + hour(l) AS INTEGER) AS hour_of_week, CAST(count(*) AS INTEGER) AS exposure FROM (
  SELECT m, (h AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM (SELECT m, unnest(generate_series(
    (CAST(m || '-01' AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC',
    ((CAST(m || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h
    FROM (SELECT DISTINCT month AS m FROM evnet))) GROUP BY ALL),
evpanel AS (SELECT n.cell, n.month, h.hour_of_week, CAST(coalesce(i.y, 0) AS INTEGER) AS y, CAST(coalesce(r.y, 0) AS INTEGER) AS y_raw, h.exposure FROM evnet n JOIN hours h USING (month)
  LEFT JOIN (SELECT cell, month, hour_of_week, count(*) AS y FROM inc GROUP BY ALL) i USING (cell, month, hour_of_week)
  LEFT JOIN (SELECT cell, strftime(ts, '%Y-%m') AS month, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour_of_week, count(*) AS y FROM ev GROUP BY ALL) r USING (cell, month, hour_of_week))
"""


def event_panel(spark, d):
    e = events(spark, d)
    net = e.where("event_type <> 'error'").select("cell", month_label("ts").alias("month")).distinct()
    p = pan.build_panel(net, inc.incident_table(e), e)
    return p.withColumns({c: F.col(c).cast("int") for c in ("hour_of_week", "exposure")})


@query("I5_zero_filled_panel", ANCHORED + EV_PANEL + "SELECT * FROM evpanel")
def _(spark, d):
    return event_panel(spark, d)


@query("X4_busiest_slots", ANCHORED + EV_PANEL + """SELECT cell, hour_of_week, y, exposure, round(y / exposure::DOUBLE, 9) AS historical FROM (
  SELECT cell, hour_of_week, CAST(sum(y) AS BIGINT) AS y, CAST(sum(exposure) AS BIGINT) AS exposure FROM evpanel GROUP BY ALL)
ORDER BY y / exposure::DOUBLE DESC, cell, hour_of_week LIMIT 20""")
def _(spark, d):
    sums = event_panel(spark, d).groupBy("cell", "hour_of_week").agg(F.sum("y").alias("y"), F.sum("exposure").alias("exposure"))
    rate = F.col("y") / F.col("exposure")
    return sums.withColumn("historical", F.round(rate, 9)).orderBy(rate.desc(), "cell", "hour_of_week").limit(20)


@query("I6_drop_accounting", with_sql("spine", "ord", "trips") + """, t AS (SELECT cell, month FROM trips WHERE month >= '1996-01' AND starts >= 12),
m AS (SELECT DISTINCT month FROM t)
SELECT count(*) AS total, count(*) FILTER (on_net) AS in_panel, count(*) FILTER (NOT in_m) AS outside_months, count(*) FILTER (in_m AND NOT on_net) AS off_network
FROM (SELECT (cell, month) IN (SELECT (cell, month) FROM t) AS on_net, month IN (SELECT month FROM m) AS in_m FROM ord)""")
def _(spark, d):
    net = trips(spark, d).where("month >= '1996-01' AND starts >= 12")
    return pan.drop_accounting(net, orders(spark, d), "ts")


@query("I7_month_coverage", with_sql("ord", "trips") + """SELECT month, 'missing' AS problem FROM (SELECT DISTINCT month FROM trips) WHERE month NOT IN (SELECT month FROM ord WHERE o_totalprice > 495000)
UNION ALL SELECT DISTINCT month, 'unexpected' FROM ord WHERE o_totalprice > 495000 AND month NOT IN (SELECT month FROM trips)""")
def _(spark, d):
    return pan.missing_months(orders(spark, d).where("o_totalprice > 495000"), trips(spark, d))


@query("I8_carry_forward", with_sql("trips") + """SELECT cell, month, starts, ends FROM trips WHERE month <= '2001-05'
UNION ALL SELECT cell, m, starts, ends FROM trips, (VALUES ('2001-06'), ('2001-07'), ('2001-08')) g(m) WHERE month = '2001-05'""")
def _(spark, d):
    return pan.carry_forward(trips(spark, d), "2001-05", "2001-09")


@query("I9_complete_series", CHANGES + "SELECT month, n FROM s")
def _(spark, d):
    return profile.monthly_series(table(spark, d, "orders"), "o_orderdate")


DAILY = """, rate AS (SELECT month, hour_of_week // 24 AS dow, sum(mu / exposure) AS predicted FROM scored WHERE exposure > 0 GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(CAST(min(month) || '-01' AS TIMESTAMP), CAST(max(month) || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM scored),
obs AS (SELECT CAST(ts AS DATE) AS day, count(*) AS observed FROM ord WHERE (cell, month) IN (SELECT (cell, month) FROM scored) GROUP BY ALL),
daily AS (SELECT day, coalesce(observed, 0)::DOUBLE AS observed, coalesce(predicted, 0) AS predicted FROM days
  LEFT JOIN rate ON month = strftime(day, '%Y-%m') AND dow = isodow(day) - 1 LEFT JOIN obs USING (day))
"""


def daily(spark, d):
    o = orders(spark, d).select("cell", "month", F.col("ts").alias("start"))
    return level.daily_totals(scored(spark, d), o)


@query("I10_daily_totals", with_sql("scored", "ord") + DAILY + "SELECT day, observed, round(predicted, 9) AS predicted FROM daily")
def _(spark, d):
    return daily(spark, d).withColumn("predicted", F.round("predicted", 9))


TRAIL = "coalesce(sum(n) OVER (PARTITION BY cell ORDER BY month_idx RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0)"


@query("N1_trailing_sums", with_sql("spine", "ord") + f""", c AS (SELECT cell, month_idx, month, coalesce(n, 0) AS n FROM spine LEFT JOIN (SELECT cell, month_idx, count(*) AS n FROM ord GROUP BY ALL) USING (cell, month_idx))
SELECT cell, month, {', '.join(f'CAST({TRAIL.format(w=w)} AS DOUBLE) AS n_{w}m' for w in (1, 3, 12))} FROM c""")
def _(spark, d):
    counts = orders(spark, d).groupBy("cell", "month_idx").agg(F.count("*").alias("n"))
    out = trailing.trailing_features(spine(spark, d).select("cell", "month_idx"), [(counts, "n")], ["cell"],
                                     {f"n_{w}m": ("n", w) for w in (1, 3, 12)})
    from weekcell.functions.calendar import index_label
    return out.withColumn("month", index_label("month_idx")).drop("month_idx")


@query("N2_rolling_factor", with_sql("scored") + """, m AS (SELECT month, CAST(sum(y) AS BIGINT) AS observed, sum(mu) AS predicted FROM scored GROUP BY month)
SELECT month, observed, round(predicted, 6) AS predicted, CASE WHEN count(*) OVER w = 3 THEN round(sum(observed) OVER w / sum(predicted) OVER w, 9) END AS factor
FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    return level.monthly_factor(scored(spark, d)).select(
        "month", "observed", F.round("predicted", 6).alias("predicted"), F.round("factor", 9).alias("factor"))


@query("N3_month_changes", CHANGES + "SELECT * FROM ch")
def _(spark, d):
    return trailing.month_changes(profile.monthly_series(table(spark, d, "orders"), "o_orderdate"))


@query("N4_first_method_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS rn FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return global_running_sum(o, ["o_orderpriority", "o_orderstatus", "o_orderkey"]).select("o_orderkey", "rn")


@query("N5_equal_bins", """SELECT o_orderkey, CAST(greatest(1, ceil((rn - 1)::DOUBLE * 10 / (n - 1))) AS INTEGER) AS decile FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""")
def _(spark, d):
    ranked = global_running_sum(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    n = ranked.agg(F.count("*").alias("n"))
    return ranked.select("o_orderkey", equal_bins(F.col("rn"), n.scalar()).alias("decile"))


@query("N7_day_window_ratio", with_sql("scored", "ord") + DAILY + """SELECT day, count(*) OVER w AS covered, round(sum(observed) OVER w / sum(predicted) OVER w, 9) AS factor
FROM daily WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 55 DAY PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return level.trailing_day_factors(daily(spark, d)).select("day", "covered", F.round("factor", 9).alias("factor"))


WEEKLY = DAILY + """, win AS (SELECT day, count(*) OVER w AS covered, sum(observed) OVER w / sum(predicted) OVER w AS factor FROM daily WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 55 DAY PRECEDING AND CURRENT ROW)),
wk AS (SELECT d.day, w.factor FROM daily d JOIN win w ON w.day = d.day - CAST(isodow(d.day) - 1 AS INTEGER) - 2 AND w.covered = 56)
"""


def weekly(spark, d):
    """Weekly factors over the days whose windows are covered."""
    totals = daily(spark, d)
    first = totals.agg(F.min("day").alias("d"))
    ready = F.date_sub(F.date_sub("day", F.weekday("day")), 2 + 55) >= first.scalar()
    return level.weekly_factor(totals, totals.where(ready))


@query("N8_weekly_factor", with_sql("scored", "ord") + WEEKLY + "SELECT day, round(factor, 9) AS factor FROM wk")
def _(spark, d):
    return weekly(spark, d).select("day", F.round("factor", 9).alias("factor"))


@query("N9_session_definitions", ANCHORED + """SELECT (SELECT count(*) FROM inc) AS anchored, (SELECT count(*) FROM (
  SELECT ts, lag(ts) OVER (PARTITION BY cell ORDER BY ts) AS p FROM ev) WHERE p IS NULL OR ts > p + INTERVAL 15 MINUTE) AS chained, (SELECT count(*) FROM ev) AS events""")
def _(spark, d):
    e = events(spark, d)
    chained = inc.chained_sessions(e).select("cell", "session_start").distinct().agg(F.count("*").alias("n"))
    one = inc.anchored_incidents(e).agg(F.count("*").alias("anchored"), F.sum("n_events").alias("events"))
    return one.withColumn("chained", chained.scalar())
