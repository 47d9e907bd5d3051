"""S: scans and sources. W: store maintenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcell.catalog.inputs import background, events, orders, segments, table, with_sql
from weekcell.catalog.registry import query
from weekcell.catalog.stages import scratch
from weekcell.functions.calendar import (index_label, is_complete, label_index, month_chunks, month_label, month_span,
                                         month_spine, month_start, overlap_start)
from weekcell.sources import readers, store, versions
from weekcell.sources.schemas import LOT_COLUMNS

PAIR = ("1-URGENT", "F")
CUT = "1998-01-01"


def as_requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the event store's vocabulary."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("unique_key"), F.col("o_orderdate").alias("created_date"),
        F.col("o_orderpriority").alias("complaint_type"), F.col("o_orderstatus").alias("descriptor"),
        F.col("o_totalprice").alias("latitude"))


@query("S1_route_sources", """
SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'archive' ELSE 'current' END AS source_dataset,
  strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, d):
    read = lambda s: as_requests(s, d)
    sources = [readers.Coverage("archive", read, None, CUT), readers.Coverage("current", read, CUT, None)]
    rows = readers.routed_scan(spark, sources, None, None)
    return rows.groupBy("source_dataset", month_label("created_date").alias("month")).agg(F.count("*").alias("n"))


@query("S2_month_chunks", """
WITH r AS (SELECT o_orderstatus, o_orderpriority, CAST(min(o_orderdate) AS DATE) + 9 AS s, CAST(max(o_orderdate) AS DATE) AS e
  FROM orders GROUP BY ALL),
m AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', s), CAST(e - 1 AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m0 FROM r)
SELECT o_orderstatus, o_orderpriority, greatest(m0, s) AS lo, least(CAST(m0 + INTERVAL 1 MONTH AS DATE), e) AS hi FROM m""")
def _(spark, d):
    ranges = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.date_add(F.to_date(F.min("o_orderdate")), 9).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return month_chunks(ranges).drop("start", "end")


@query("S3_month_spine", with_sql("months") + """
SELECT month, CAST(month || '-01' AS TIMESTAMP) AS lo, CAST(month || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH AS hi,
  strftime(CAST(month || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH, '%Y-%m') AS next_month,
  strftime(CAST(month || '-01' AS TIMESTAMP) - INTERVAL 12 MONTH, '%Y-%m') AS year_before FROM months""")
def _(spark, d):
    m = F.col("month_idx")
    return month_spine(month_span(table(spark, d, "orders"), "o_orderdate")).select(
        index_label(m).alias("month"), month_start(m).alias("lo"), month_start(m + 1).alias("hi"),
        index_label(m + 1).alias("next_month"), index_label(m - 12).alias("year_before"))


@query("S4_target_scan", """
SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, o_orderdate AS created_date, o_orderpriority AS complaint_type,
  o_orderstatus AS descriptor, o_totalprice AS latitude FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'""")
def _(spark, d):
    return readers.target_rows(as_requests(spark, d), PAIR, "1996-01-01", "2001-01-01")


def located_requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests with coordinates; some kinds and details are null."""
    k = F.col("event_id")
    return events(spark, d).select(
        F.col("event_id").cast("string").alias("unique_key"), F.col("ts").alias("created_date"),
        F.when(k % 13 != 0, F.col("event_type")).alias("complaint_type"),
        F.when(k % 11 != 0, F.when(F.col("value") > 10, "high").otherwise("low")).alias("descriptor"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


REQ = """, req AS (SELECT event_id, ts AS created_date, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS complaint_type,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > 10 THEN 'high' ELSE 'low' END AS descriptor, lat, lon FROM ev) """


@query("S5_background_grid", with_sql("ev") + REQ + """
SELECT round(round(lat / 0.002::DOUBLE) * 0.002::DOUBLE, 3) AS grid_lat, round(round(lon / 0.002::DOUBLE) * 0.002::DOUBLE, 3) AS grid_lon, count(*) AS n
FROM req WHERE complaint_type IS NULL OR descriptor IS NULL OR NOT (complaint_type = 'error' AND descriptor = 'low') GROUP BY ALL""")
def _(spark, d):
    return readers.background_grid(located_requests(spark, d), ("error", "low"), None, None)


@query("S6_normalize_rows", """
SELECT CAST(event_id AS VARCHAR) AS unique_key, ts AS created_date, CAST(NULL AS TIMESTAMP) AS closed_date,
  event_type AS complaint_type, value AS latitude, CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS VARCHAR) AS borough,
  'feed' AS source_dataset FROM events""")
def _(spark, d):
    text = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("unique_key"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_date"),
        F.col("event_type").alias("complaint_type"), F.col("value").cast("string").alias("latitude"))
    return readers.normalize_events(text, "feed").select(
        "unique_key", "created_date", "closed_date", "complaint_type", "latitude", "longitude", "borough", "source_dataset")


@query("S7_geojson_points", with_sql("ev") + """
SELECT '2024-01' AS month, round(lat, 3) AS grid_lat, round(lon, 3) AS grid_lon, CAST(user_id AS BIGINT) AS n,
  true AS month_complete, 'feed' AS source_dataset FROM ev""")
def _(spark, d):
    g = F.when(F.col("lat").isNotNull(), F.to_json(F.struct(
        F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))))
    rows = events(spark, d).select(g.alias("g"), F.col("user_id").alias("n"))
    return readers.grid_from_geojson(rows, "2024-01", True, "feed")


@query("S8_geojson_lines", with_sql("seg") + """
SELECT segment_id, status, lane_class, valid_from, valid_to, exclude_reason, usable, CAST(NULL AS VARCHAR) AS street,
  CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS parts, CAST(CASE WHEN k % 2 = 0 THEN 5 ELSE 3 END AS INTEGER) AS vertices FROM seg""")
def _(spark, d):
    # half of the lines have one part of three vertices, half a second part of two
    pt = lambda i: F.array(F.lit(-74.0) + (F.col("k") % 100 + i) / 10000, F.lit(40.7) + (F.col("k") % 37 + i) / 10000)
    one = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(pt(0), pt(1), pt(2)).alias("coordinates")))
    two = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array(
        F.array(pt(0), pt(1), pt(2)), F.array(pt(4), pt(5))).alias("coordinates")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    raw = segments(spark, d).select(
        F.col("segment_id").alias("route_id"), "status", F.col("lane_class").alias("facilitycl"),
        text("valid_from").alias("instdate"), text("valid_to").alias("ret_date"),
        F.when(F.col("k") % 2 == 0, two).otherwise(one).alias("the_geom"))
    lines = readers.normalize_lines(raw)
    return lines.select("segment_id", "status", "lane_class", "valid_from", "valid_to", "exclude_reason", "usable", "street",
                        F.size("points").alias("parts"),
                        F.aggregate("points", F.lit(0), lambda a, p: a + F.size(p)).alias("vertices"))


TRIP_ENDS = """
WITH e AS (
  SELECT 'start' AS kind, strftime(l_shipdate, '%Y-%m') AS month, 40.5::DOUBLE + (l_suppkey % 50) / 100.0::DOUBLE AS lat, -74.0::DOUBLE AS lng FROM lineitem
  UNION ALL SELECT 'end', strftime(l_shipdate + INTERVAL 3 DAY, '%Y-%m'),
    CASE WHEN l_linenumber = 7 THEN NULL ELSE 40.5::DOUBLE + (l_partkey % 40) / 100.0::DOUBLE END, -73.9::DOUBLE FROM lineitem)
SELECT kind, month, round(lat, 5) AS lat, lng, count(*) AS n FROM e GROUP BY ALL"""


def trip_frames(spark: SparkSession, d: str) -> list[DataFrame]:
    """Line items as trips, in the newer and in the older layout."""
    li = table(spark, d, "lineitem")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    base = li.select("l_linestatus", stamp("l_shipdate").alias("t0"),
                     stamp(F.col("l_shipdate") + F.expr("interval 3 days")).alias("t1"),
                     (F.lit(40.5) + F.col("l_suppkey") % 50 / 100).cast("string").alias("la0"),
                     F.when(F.col("l_linenumber") == 7, "n/a").otherwise(
                         (F.lit(40.5) + F.col("l_partkey") % 40 / 100).cast("string")).alias("la1"))
    new = base.where(F.col("l_linestatus") == "O").select(
        F.col("t0").alias(" Started_At"), F.col("t1").alias("ended_at"), F.col("la0").alias("start_lat"),
        F.lit("-74.0").alias("start_lng"), F.col("la1").alias("end_lat"), F.lit("-73.9").alias("end_lng"))
    old = base.where(F.col("l_linestatus") != "O").select(
        F.col("t0").alias("starttime"), F.col("t1").alias("stoptime"), F.col("la0").alias("Start Station Latitude"),
        F.lit("-74.0").alias("start station longitude"), F.col("la1").alias("end station latitude"),
        F.lit("-73.9").alias("end station longitude"))
    return [new, old]


@query("S9_trip_layouts", TRIP_ENDS)
def _(spark, d):
    return readers.trip_ends(readers.unify_trips(trip_frames(spark, d)))


@query("S17_delimited_files", TRIP_ENDS)
def _(spark, d):
    """The same trips from delimited files of both layouts in one folder tree, each file with a header of its own."""
    folder = scratch(spark, "trips")
    for k, frame in enumerate(trip_frames(spark, d)):
        frame.write.option("header", True).csv(f"{folder}/{k}")
    return readers.trip_ends(readers.read_trips(spark, [f"{folder}/{k}" for k in range(2)]))


def archive_names(spark: SparkSession, d: str) -> DataFrame:
    """One monthly archive per order month, one yearly archive per order year, and a stray file each."""
    day = F.col("o_orderdate")
    name = F.explode(F.array(
        F.concat(F.date_format(day, "yyyyMM"), F.lit("-citibike-tripdata.csv.zip")),
        F.concat(F.date_format(day, "yyyy"), F.lit("-citibike-tripdata.zip")),
        F.concat(F.lit("JC-"), F.date_format(day, "yyyyMM"), F.lit("-citibike-tripdata.csv.zip"))))
    return table(spark, d, "orders").select(name.alias("name")).distinct()


@query("S10_archive_listing", """
SELECT DISTINCT name, CAST(substr(name, 1, 4) AS INTEGER) AS year FROM (
  SELECT unnest([strftime(o_orderdate, '%Y%m') || '-citibike-tripdata.csv.zip', strftime(o_orderdate, '%Y') || '-citibike-tripdata.zip']) AS name
  FROM orders) WHERE CAST(substr(name, 1, 4) AS INTEGER) >= 1997""")
def _(spark, d):
    files = archive_names(spark, d).select(F.concat(F.lit("/archives/"), "name").alias("path"))
    return readers.list_archives(files, 1997).select("name", "year")


@query("S11_covered_through", "SELECT strftime(max(o_orderdate), '%Y-%m') AS covered FROM orders")
def _(spark, d):
    return readers.covered_through(archive_names(spark, d))


@query("S12_numeric_coercion", """
SELECT CAST(p_partkey AS VARCHAR) AS bbl, '24v1' AS version, CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS lotfront,
  p_retailprice AS retailarea, CAST(NULL AS DOUBLE) AS comarea FROM part""")
def _(spark, d):
    raw = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("bbl"), F.lit("24v1").alias("version"),
        F.when(F.col("p_size") % 10 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" ft"))).otherwise(
            F.col("p_size").cast("string")).alias("lotfront"), F.col("p_retailprice").cast("string").alias("retailarea"))
    lots = readers.normalize_lots(raw)
    assert lots.columns == LOT_COLUMNS
    return lots.select("bbl", "version", "lotfront", "retailarea", "comarea")


@query("S12_single_version", """
SELECT strftime(o_orderdate, '%Y') AS version, count(*) AS lots, count(*) FILTER (o_orderpriority NOT LIKE '5%') AS with_front FROM orders
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY ALL""")
def _(spark, d):
    """Lots of the newest snapshot, after the guard that they come from one version."""
    raw = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("bbl"), F.date_format("o_orderdate", "yyyy").alias("version"),
        F.when(F.col("o_orderpriority").startswith("5"), "none").otherwise(F.col("o_totalprice").cast("string")).alias("lotfront"))
    lots = readers.normalize_lots(readers.latest_snapshot(raw))
    readers.check_single_version(lots)
    return lots.groupBy("version").agg(F.count("*").alias("lots"), F.count("lotfront").alias("with_front"))


@query("S13_latest_snapshot", """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y') AS version FROM orders
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""")
def _(spark, d):
    snaps = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("version"))
    return readers.latest_snapshot(snaps)


NOW = datetime(2001, 9, 1, 12, 0)


def first_pull(spark: SparkSession, d: str) -> DataFrame:
    """Everything up to the end of 2000, as seen by the first pull."""
    return as_requests(spark, d).where(F.col("created_date") < F.lit("2001-01-01").cast("timestamp_ntz"))


def second_pull(spark: SparkSession, d: str) -> DataFrame:
    """A later pull of mid-2000 onward: open requests were closed, pending ones vanished, some lost their number."""
    later = as_requests(spark, d).where(F.col("created_date") >= F.lit("2000-07-01").cast("timestamp_ntz"))
    return (later.where(F.col("descriptor") != "P")
            .withColumn("descriptor", F.when(F.col("descriptor") == "O", "F").otherwise(F.col("descriptor")))
            .withColumn("latitude", F.when(F.col("latitude") < 100000, F.lit(None)).otherwise(F.col("latitude"))))


PULLS = """
WITH req AS (SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, o_orderdate AS created_date, o_orderpriority AS complaint_type,
  o_orderstatus AS descriptor, o_totalprice AS latitude FROM orders),
old AS (SELECT * FROM req WHERE created_date < TIMESTAMP '2001-01-01'),
new AS (SELECT unique_key, created_date, complaint_type, CASE WHEN descriptor = 'O' THEN 'F' ELSE descriptor END AS descriptor,
  CASE WHEN latitude < 100000 THEN NULL ELSE latitude END AS latitude FROM req WHERE created_date >= TIMESTAMP '2000-07-01' AND descriptor <> 'P')
"""
MERGED = "SELECT * FROM new UNION ALL SELECT * FROM old WHERE unique_key NOT IN (SELECT unique_key FROM new)"
CHANGES = """SELECT {key} count(new.unique_key) AS fetched, count(*) FILTER (old.unique_key IS NULL) AS "new",
  count(*) FILTER (new.unique_key IS NOT NULL AND old.unique_key IS NOT NULL AND
    (new.created_date, new.complaint_type, new.descriptor, new.latitude) IS DISTINCT FROM (old.created_date, old.complaint_type, old.descriptor, old.latitude)) AS updated,
  count(*) FILTER (new.unique_key IS NULL) AS missing_from_source, count(*) AS "rows" FROM old FULL JOIN new USING (unique_key) {group}"""
MONTH_OF = "strftime(coalesce(new.created_date, old.created_date), '%Y-%m')"
CONTENT = ["created_date", "complaint_type", "descriptor", "latitude"]


@query("W1_upsert", PULLS + MERGED)
def _(spark, d):
    return store.merge_newest(first_pull(spark, d), second_pull(spark, d))


@query("W2_change_counts", PULLS + CHANGES.format(key=f"{MONTH_OF} AS month,", group="GROUP BY ALL"))
def _(spark, d):
    return store.change_counts(first_pull(spark, d).transform(readers.with_month),
                               second_pull(spark, d).transform(readers.with_month), CONTENT, by=["month"])


@query("W3_duplicate_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(spark, d):
    return store.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey")


@query("W4_stray_rows", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders
WHERE strftime(o_orderdate, '%Y-%m') NOT IN ('1996-02', '1996-03', '1999-12') GROUP BY ALL""")
def _(spark, d):
    stray = store.stray_rows(as_requests(spark, d), ["1996-02", "1996-03", "1999-12"])
    return stray.groupBy(month_label("created_date").alias("month")).agg(F.count("*").alias("n"))


def order_months(spark: SparkSession, d: str) -> list[str]:
    rows = month_spine(month_span(table(spark, d, "orders"), "o_orderdate")).select(index_label("month_idx").alias("m"))
    return sorted(r["m"] for r in rows.collect())  # the month calendar


@query("W5_month_store", PULLS + "SELECT *, strftime(created_date, '%Y-%m') AS month FROM (" + MERGED + ")")
def _(spark, d):
    path, months = scratch(spark, "store"), order_months(spark, d)
    store.ingest_rows(spark, path, first_pull(spark, d), [m for m in months if m < "2001-01"], NOW)
    again = [m for m in months if m >= "2000-07"]
    store.ingest_rows(spark, path, second_pull(spark, d), again, NOW)
    store.ingest_rows(spark, path, second_pull(spark, d), again, NOW)  # the same pull again changes nothing
    return readers.read_store(spark, path)


@query("W6_replace_months", """
WITH g AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(l_suppkey AS DOUBLE) AS grid_lat,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS grid_lon, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT month, grid_lat, grid_lon, CAST(CASE WHEN month >= '2001-01' THEN 2 * n ELSE n END AS BIGINT) AS n FROM g
WHERE month < (SELECT max(month) FROM g)""")
def _(spark, d):
    """All months, then the latest ones again with doubled counts; the last month is asked for, comes back empty and is emptied."""
    path = scratch(spark, "grid")
    line = F.col("l_linenumber")
    grid = table(spark, d, "lineitem").groupBy(
        month_label("l_shipdate").alias("month"), F.col("l_suppkey").cast("double").alias("grid_lat"),
        F.when(line != 1, line.cast("double")).alias("grid_lon")).agg(F.count("*").alias("n"))
    months = sorted(r["month"] for r in grid.select("month").distinct().collect())  # the month calendar
    store.ingest_grid(spark, path, grid, months, NOW)
    again = [m for m in months if m >= "2001-01"]
    doubled = grid.where(F.col("month").isin(again[:-1])).withColumn("n", F.col("n") * 2)
    store.ingest_grid(spark, path, doubled, again, NOW)
    return readers.read_store(spark, path, ["month", "grid_lat", "grid_lon", "n"])


@query("W6_superseded", """
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS "rows" FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') >= '1998-01' GROUP BY ALL""")
def _(spark, d):
    """Months whose first version another one has replaced, with the rows which that version still holds for readers of the older snapshot."""
    path = scratch(spark, "lines")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", month_label("l_shipdate").alias("month"))
    months = sorted(r["month"] for r in lines.select("month").distinct().collect())  # the month calendar
    versions.replace_months(spark, path, lines, months, NOW, ["l_orderkey"])
    versions.replace_months(spark, path, lines.where("l_linenumber > 1 AND month >= '1998-01'"), [m for m in months if m >= "1998-01"], NOW)
    old = versions.manifest(spark, path).join(versions.superseded(spark, path), ["month", "pull"], "left_semi")
    return old.select("month", "rows")


@query("W7_all_months", with_sql("months") + """
SELECT month, coalesce(n, 0) AS n FROM months LEFT JOIN (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    AND o_totalprice > 400000 GROUP BY ALL) USING (month)""")
def _(spark, d):
    rare = as_requests(spark, d).where((F.col("complaint_type") == PAIR[0]) & (F.col("descriptor") == PAIR[1]) & (F.col("latitude") > 400000))
    stats = rare.groupBy(month_label("created_date").alias("month")).agg(F.count("*").alias("n"))
    spine = month_spine(month_span(table(spark, d, "orders"), "o_orderdate")).select(index_label("month_idx").alias("month"))
    return store.with_all_months(stats, spine)


@query("W8_control_newest", """
SELECT o_custkey, max(o_orderdate) AS pulled_at, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def _(spark, d):
    log = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("pulled_at"), "o_orderkey")
    return store.newest_rows(log, "o_custkey", "pulled_at")


@query("W9_completeness", """
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderdate + to_hours(CAST(o_orderkey % 960 AS INTEGER)) AS pulled FROM orders)
SELECT month, count(*) AS pulls, count(*) FILTER (
  CAST(CAST(month || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH AS DATE) + 3 <= CAST((pulled AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)) AS complete
FROM p GROUP BY month""")
def _(spark, d):
    o = table(spark, d, "orders")
    pulled = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 960).cast("int"))
    rows = o.select(month_label("o_orderdate").alias("month"), pulled.alias("pulled"))
    flag = is_complete(label_index("month"), F.col("pulled"))
    return rows.groupBy("month").agg(F.count("*").alias("pulls"), F.count_if(flag).alias("complete"))


def control(spark: SparkSession, d: str) -> DataFrame:
    """Two stores with one control row per month; months with few large orders or shipments are incomplete."""
    def one(df: DataFrame, name: str, ts: str, big) -> DataFrame:
        return df.groupBy(month_label(ts).alias("month")).agg(
            F.lit(name).alias("store"), F.max(ts).alias("pulled_at"),
            (F.count_if(big) > 0.08 * F.count("*")).alias("complete"), F.count("*").alias("rows"))
    return one(table(spark, d, "orders"), "orders", "o_orderdate", F.col("o_totalprice") > 450000).unionByName(
        one(table(spark, d, "lineitem"), "lineitem", "l_shipdate", F.col("l_quantity") > 45))


CONTROL = """WITH ctl AS (
  SELECT 'orders' AS store, strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_totalprice > 450000) > 0.08 * count(*) AS complete FROM orders GROUP BY ALL
  UNION ALL SELECT 'lineitem', strftime(l_shipdate, '%Y-%m'), count(*) FILTER (l_quantity > 45) > 0.08 * count(*) FROM lineitem GROUP BY ALL),
hi AS (SELECT min(last) AS hi FROM (SELECT store, max(month) AS last FROM ctl WHERE complete GROUP BY store))
"""


@query("W10_build_range", CONTROL + """, m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT store, month FROM (SELECT DISTINCT store FROM ctl), m, hi WHERE month >= '1995-02' AND month <= hi.hi
  AND (store, month) NOT IN (SELECT (store, month) FROM ctl WHERE complete)""")
def _(spark, d):
    return store.incomplete_months(control(spark, d), "1995-02")


@query("W11_overlap_start", "SELECT strftime(max(o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') AS start_month FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg(overlap_start(F.max(month_label("o_orderdate"))).alias("start_month"))


@query("W14_unprocessed_files", """
SELECT DISTINCT strftime(o_orderdate, '%Y%m') || '-citibike-tripdata.csv.zip' AS name FROM orders
WHERE strftime(o_orderdate, '%Y%m') NOT IN (SELECT strftime(l_shipdate, '%Y%m') FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09)""")
def _(spark, d):
    names = lambda df, ts: df.select(F.concat(F.date_format(ts, "yyyyMM"), F.lit("-citibike-tripdata.csv.zip")).alias("name")).distinct()
    done = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09")
    return store.unprocessed(names(table(spark, d, "orders"), "o_orderdate"), names(done, "l_shipdate"))


@query("W15_pull_summary", PULLS + ", c AS (" + CHANGES.format(key=f"{MONTH_OF} AS month,", group="GROUP BY ALL") + """)
SELECT count(*) AS months, min(month) AS first_month, max(month) AS last_month, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum("new") AS BIGINT) AS "new",
  CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(missing_from_source) AS BIGINT) AS missing_from_source FROM c""")
def _(spark, d):
    stats = store.change_counts(first_pull(spark, d).transform(readers.with_month),
                                second_pull(spark, d).transform(readers.with_month), CONTENT, by=["month"])
    return store.pull_summary(stats)


@query("S15_pruned_scan", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1999-01' AND '1999-12' GROUP BY ALL""")
def _(spark, d):
    # the month range reaches the scan as a time filter, so row groups outside it are skipped
    year = readers.in_dates("o_orderdate", "1999-01-01", "2000-01-01")
    return (table(spark, d, "orders").where(year).groupBy("o_orderpriority")
            .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


def background_store(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "background")
    rows = background(spark, d)
    months = sorted(r["month"] for r in rows.select("month").distinct().collect())  # the month calendar
    versions.replace_months(spark, path, rows, months, NOW, ["cell"])
    return path


@query("S14_read_store", "SELECT 'c' || (l_orderkey // 600) AS cell, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    return readers.read_store(spark, background_store(spark, d), ["cell", "month", "n"])


@query("S15_month_list", """
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem
WHERE strftime(l_shipdate, '%m') IN ('03', '11') GROUP BY ALL""")
def _(spark, d):
    """Every March and November of a store: the other months' folders are not listed."""
    path = background_store(spark, d)
    picked = [m for m in versions.current(spark, path) if m[5:] in ("03", "11")]
    return readers.read_store(spark, path, ["month", "n"], picked).groupBy("month").agg(F.sum("n").alias("n"))


@query("S16_source_callables", """
SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'archive' ELSE 'current' END AS source_dataset,
  strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, d):
    """Two kinds of source behind one interface, a callable: a table, and text files that a normalizing reader types."""
    folder = scratch(spark, "texts")
    as_requests(spark, d).select("unique_key", F.date_format("created_date", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("created_date"),
                                 "complaint_type", "descriptor").write.json(folder)
    files = lambda s: readers.normalize_events(
        s.read.schema("unique_key string, created_date string, complaint_type string, descriptor string").json(folder), "files")
    sources = [readers.Coverage("archive", lambda s: as_requests(s, d), None, CUT), readers.Coverage("current", files, CUT, None)]
    found = readers.routed_scan(spark, sources, None, None)
    return found.groupBy("source_dataset", month_label("created_date").alias("month")).agg(F.count("*").alias("n"))


@query("W12_run_counters", "SELECT count(*) AS events_total, count(DISTINCT o_custkey) AS customers, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders")
def _(spark, d):
    path = scratch(spark, "runs")
    counters = orders(spark, d).agg(F.count("*").alias("events_total"), F.count_distinct("o_custkey").alias("customers"),
                                    F.count_distinct("month").alias("months"))
    store.append_run_log(path, counters)
    return spark.read.schema("events_total bigint, customers bigint, months bigint").json(path)
