"""P: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcell.catalog.inputs import SPLITS, events, months, orders, segments, table, with_sql
from weekcell.catalog.registry import query
from weekcell.functions import calendar as cal, geo, predicates as pred
from weekcell.plans import profile

EVENT_HOW = "CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER)"


@query("P1_target_predicate", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.where(pred.is_target("o_orderpriority", "o_orderstatus", ("2-HIGH", "O"))).select("o_orderkey")


NULLED = """(SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > 10 THEN 'high' ELSE 'low' END AS detail FROM events)"""


def nulled(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.when(k % 13 != 0, F.col("event_type")).alias("kind"),
        F.when(k % 11 != 0, F.when(F.col("value") > 10, "high").otherwise("low")).alias("detail"))


@query("P2_complement_predicate", f"SELECT event_id, kind, detail FROM {NULLED} WHERE (kind = 'view' AND detail = 'high') IS NOT TRUE")
def _(spark, d):
    return nulled(spark, d).where(pred.is_not_target("kind", "detail", ("view", "high")))


@query("P3_date_predicate", """
SELECT 'closed' AS bounds, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1999-11-15'
UNION ALL SELECT 'from', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01'
UNION ALL SELECT 'until', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1999-11-15' UNION ALL SELECT 'open', count(*) FROM orders""")
def _(spark, d):
    lo, hi = "1996-03-01", "1999-11-15"
    cases = {"closed": (lo, hi), "from": (lo, None), "until": (None, hi), "open": (None, None)}
    counts = table(spark, d, "orders").agg(*[F.count_if(pred.in_dates("o_orderdate", *b)).alias(n) for n, b in cases.items()])
    return counts.unpivot([], list(cases), "bounds", "n")


@query("P4_hour_of_week", f"SELECT event_id, {EVENT_HOW} AS hour_of_week FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cal.hour_of_week("ts").cast("int").alias("hour_of_week"))


@query("P5_slot_from_parts", f"SELECT event_id, {EVENT_HOW} AS from_sunday, {EVENT_HOW} AS from_monday FROM events")
def _(spark, d):
    sunday = F.dayofweek("ts") - 1
    return table(spark, d, "events").select(
        "event_id", cal.hour_of_week_from_parts(sunday, F.hour("ts"), True).cast("int").alias("from_sunday"),
        cal.hour_of_week_from_parts(F.weekday("ts"), F.hour("ts"), False).cast("int").alias("from_monday"))


@query("P6_bounding_box", with_sql("ev") + """
SELECT event_id, coalesce(lat BETWEEN 40.47 AND 40.93 AND lon BETWEEN -74.27 AND -73.68, false) AS inside FROM ev""")
def _(spark, d):
    return events(spark, d).select("event_id", pred.in_bbox("lat", "lon").alias("inside"))


@query("P7_scope", with_sql("seg") + "SELECT segment_id, lane_class IN ('I', 'II') AND on_street = 'ON' AS lanes_on_street, true AS everything FROM seg")
def _(spark, d):
    return segments(spark, d).select("segment_id", pred.in_scope("lanes_on_street").alias("lanes_on_street"),
                                     pred.in_scope("all").alias("everything"))


ACTIVE_SQL = "coalesce(usable AND valid_from <= {t} AND (valid_to IS NULL OR {t} < valid_to), false)"


@query("P8_active_at", with_sql("seg") + "SELECT segment_id, " + ", ".join(
    ACTIVE_SQL.format(t=f"TIMESTAMP '{t}'") + f" AS {n}" for n, t in (("at_start", "2023-07-04 00:00:00"), ("at_mid", "2024-01-15 12:30:00"))) + " FROM seg")
def _(spark, d):
    at = lambda t: pred.active_at(F.lit(t).cast("timestamp_ntz"))
    return segments(spark, d).select("segment_id", at("2023-07-04 00:00:00").alias("at_start"), at("2024-01-15 12:30:00").alias("at_mid"))


@query("P9_active_in_month", with_sql("seg") + """
SELECT segment_id, m AS month, coalesce(usable AND valid_from <= CAST(m || '-01' AS TIMESTAMP)
  AND (valid_to IS NULL OR valid_to >= CAST(m || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH), false) AS active
FROM seg, (VALUES ('2023-07'), ('2023-12'), ('2024-01'), ('2024-06')) t(m)""")
def _(spark, d):
    m = F.explode(F.array(*[F.lit(x) for x in ("2023-07", "2023-12", "2024-01", "2024-06")])).alias("month")
    return segments(spark, d).select("*", m).select(
        "segment_id", "month", pred.active_in_month(cal.label_index("month")).alias("active"))


@query("P10_quality_class", with_sql("seg") + "SELECT segment_id, exclude_reason, usable FROM seg")
def _(spark, d):
    return segments(spark, d).select("segment_id", "exclude_reason", "usable")


@query("P11_lane_type", with_sql("seg") + """
SELECT segment_id, CASE WHEN lane_class = 'I' THEN 'protected' WHEN coalesce(ft_facility, tf_facility, '') LIKE 'Curbside%' THEN 'curbside'
  WHEN coalesce(ft_facility, tf_facility, '') LIKE 'Conventional Buffered%' THEN 'buffered' ELSE 'conventional' END AS lane_type FROM seg""")
def _(spark, d):
    return segments(spark, d).select("segment_id", pred.lane_type().alias("lane_type"))


@query("P12_snap_to_grid", with_sql("ev") + """
SELECT event_id, round(round(lat / 0.002::DOUBLE) * 0.002::DOUBLE, 3) AS grid_lat, round(round(lon / 0.002::DOUBLE) * 0.002::DOUBLE, 3) AS grid_lon FROM ev""")
def _(spark, d):
    return events(spark, d).select("event_id", geo.snap_grid("lat").alias("grid_lat"), geo.snap_grid("lon").alias("grid_lon"))


@query("P13_month_label", "SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m') AS from_text FROM events")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", cal.month_label("ts").alias("month"), F.substring(F.col("ts").cast("string"), 1, 7).alias("from_text"))


@query("P14_calendar_parts", f"""SELECT event_id, CAST(month(ts) AS INTEGER) AS month_of_year, CAST({EVENT_HOW} // 24 AS INTEGER) AS day_of_week,
  CAST({EVENT_HOW} % 24 AS INTEGER) AS "hour" FROM events""")
def _(spark, d):
    how = cal.hour_of_week("ts")
    return table(spark, d, "events").select(
        "event_id", cal.month_of_year(cal.month_index("ts")).cast("int").alias("month_of_year"),
        cal.day_of_week(how).alias("day_of_week"), cal.hour_of_day(how).alias("hour"))


@query("P15_age_in_months", """
SELECT o_orderkey, CAST((2001 - year(o_orderdate)) * 12 + (8 - month(o_orderdate)) AS INTEGER) AS age_months FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", cal.months_between_calendar(cal.label_index(F.lit("2001-08")), "o_orderdate").cast("int").alias("age_months"))


@query("P16_split", """
SELECT split, count(*) AS n FROM (SELECT CASE WHEN m BETWEEN '1995-01' AND '1998-12' THEN 'train' WHEN m BETWEEN '1999-01' AND '1999-12' THEN 'validate'
  WHEN m BETWEEN '2000-01' AND '2001-07' THEN 'test' END AS split FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m FROM orders)) GROUP BY split""")
def _(spark, d):
    return orders(spark, d).groupBy(cal.split_name("month", SPLITS).alias("split")).agg(F.count("*").alias("n"))


@query("P17_conditional_measures", with_sql("lots") + """
SELECT p_partkey, CAST(landuse IN ('4', '5') AS INTEGER) AS com_lot, CASE WHEN landuse IN ('4', '5') THEN coalesce(lotfront, 0) ELSE 0 END AS com_frontage_ft FROM lots""")
def _(spark, d):
    from weekcell.catalog.inputs import lots
    com = F.col("landuse").isin(pred.COMMERCIAL_LANDUSE)
    return lots(spark, d).select("p_partkey", com.cast("int").alias("com_lot"),
                                 F.when(com, F.coalesce("lotfront", F.lit(0.0))).otherwise(0.0).alias("com_frontage_ft"))


@query("P18_round_coordinates", with_sql("ev") + "SELECT event_id, round(lat, 5) AS lat5, CAST(NULL AS DOUBLE) AS bad FROM ev")
def _(spark, d):
    return events(spark, d).select("event_id", geo.round_coord(F.col("lat").cast("string")).alias("lat5"),
                                   geo.round_coord(F.col("event_type")).alias("bad"))


@query("P19_contains_either", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(upper(p_name), 'RING') OR contains(upper(p_type), 'RING')")
def _(spark, d):
    return table(spark, d, "part").where(pred.contains_either("p_name", "p_type", "ring")).select("p_partkey", "p_name", "p_type")


COLUMN_TABLES = ["orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events"]


@query("P20_columns_by_pattern", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, name, count(*) AS filled FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {t}) ON COLUMNS(*) INTO NAME name VALUE v) "
    "WHERE regexp_matches(name, 'status$|date$') GROUP BY ALL" for t in ("orders", "lineitem")))
def _(spark, d):
    def one(t):
        return profile.observed_columns(table(spark, d, t)).where(F.col("name").rlike("status$|date$")).select(
            F.lit(t).alias("table_name"), "name", F.col("non_null").alias("filled"))
    return one("orders").unionByName(one("lineitem"))


DAYS = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"


@query("P21_slot_labels", f"""
SELECT event_id, {DAYS}[isodow(ts)] || ' ' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00' AS label, {EVENT_HOW} AS parsed, CAST(NULL AS INTEGER) AS bad FROM events""")
def _(spark, d):
    day = F.upper(F.date_format(F.col("ts"), "EEEE"))
    return table(spark, d, "events").select(
        "event_id", cal.slot_label(cal.hour_of_week("ts")).alias("label"), cal.parse_slot(day, F.hour("ts")).alias("parsed"),
        cal.parse_slot(day, F.hour("ts") + 24).alias("bad"))


EDGES = [100000.0, 150000.0, 200000.0, 260000.0, 330000.0, 410000.0, 490000.0]


@query("P22_colour_bin", "SELECT o_orderkey, CAST(" + " + ".join(f"CAST(o_totalprice >= {e} AS INTEGER)" for e in EDGES) + " AS INTEGER) AS bin FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", pred.colour_bin("o_totalprice", EDGES).alias("bin"))


@query("P23_safe_ratio", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio, CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END AS filled FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pred.safe_ratio("l_tax", "l_discount").alias("ratio"),
                                              pred.safe_ratio("l_tax", "l_discount", 0.0).alias("filled"))


@query("P24_expected_density", """
SELECT n_cells, annual / (168 * 12) / n_cells AS per_cell_slot_168, annual / (56 * 12) / n_cells AS per_cell_slot_56
FROM (SELECT count(*) / 2.0::DOUBLE AS annual FROM orders WHERE year(o_orderdate) IN (1999, 2000)), (VALUES (2000), (4000), (6000)) t(n_cells)""")
def _(spark, d):
    annual = table(spark, d, "orders").where(F.year("o_orderdate").isin(1999, 2000)).agg((F.count("*") / F.lit(2.0)).alias("annual"))
    return profile.sparsity_table(annual)


@query("P25_drop_by_prefix", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(*pred.drop_prefixed(o.columns, ("o_orderd", "o_orders", "o_orderp")))


@query("P26_code_label", """
SELECT c_custkey, CASE n_regionkey WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Brooklyn' WHEN 3 THEN 'Queens' WHEN 4 THEN 'Staten Island' END AS borough
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, d, "customer").join(nation, "c_nationkey").select(
        "c_custkey", pred.code_label(F.col("n_regionkey") + 1).alias("borough"))


@query("P27_week_convention", "SELECT max(dayofweek(ts)) = 1 AS sunday_is_zero FROM events WHERE isodow(ts) = 1")
def _(spark, d):
    # one Monday's rows, numbered by a convention whose week starts on Sunday
    monday = table(spark, d, "events").where(F.weekday("ts") == 0)
    return profile.day_convention(monday.groupBy((F.dayofweek("ts") - 1).alias("dow")).agg(F.count("*").alias("n")))


@query("P3b_month_bounds", with_sql("months") + "SELECT month, last_day(CAST(month || '-01' AS DATE)) AS last_day FROM months")
def _(spark, d):
    return months(spark, d).select("month", F.last_day(F.to_date(cal.month_start("month_idx"))).alias("last_day"))
