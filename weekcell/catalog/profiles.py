"""D: data-quality profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcell.catalog.inputs import events, segments, table, with_sql
from weekcell.catalog.registry import query
from weekcell.catalog.relational import CHANGES, NETWORK, PAIRS, network, pair_table
from weekcell.operators.network import summarize_network
from weekcell.plans import profile


@query("D1_taxonomy", PAIRS + "SELECT * FROM m WHERE contains(upper(a), 'URGENT') OR contains(upper(b), 'URGENT')")
def _(spark, d):
    hits = profile.matching_pairs(pair_table(spark, d), "a", "b", "urgent")
    return profile.merge_pair_counts(hits, "a", "b", "src", ["old", "new"])


@query("D2_choose_target", PAIRS + "SELECT * FROM m WHERE contains(upper(a || ' ' || b), 'HIGH') AND contains(upper(a || ' ' || b), 'O') ORDER BY total DESC, a, b LIMIT 1")
def _(spark, d):
    merged = profile.merge_pair_counts(pair_table(spark, d), "a", "b", "src", ["old", "new"])
    return profile.choose_target(merged, "a", "b", ["high", "o"])


@query("D3_yearly_volume", """SELECT CAST(y AS INTEGER) AS year, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders)
LEFT JOIN (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) USING (y)""")
def _(spark, d):
    return profile.yearly_volume(table(spark, d, "orders"), "o_orderdate")


@query("D4_monthly_changes", CHANGES + """SELECT * FROM (SELECT *, 'drop' AS kind FROM ch WHERE change < 0 ORDER BY change, month LIMIT 3)
UNION ALL SELECT * FROM (SELECT *, 'rise' AS kind FROM ch WHERE change > 0 ORDER BY change DESC, month LIMIT 3)""")
def _(spark, d):
    return profile.largest_changes(profile.monthly_series(table(spark, d, "orders"), "o_orderdate"), 3)


@query("D5_coordinate_quality", with_sql("ev") + """SELECT *, round(null_latlon / "rows"::DOUBLE, 6) AS null_share, round(outside_bbox / "rows"::DOUBLE, 6) AS outside_share FROM (
  SELECT year(ts) AS year, count(*) AS "rows", count(*) FILTER (lat IS NULL OR lon IS NULL) AS null_latlon,
  count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat BETWEEN 40.47 AND 40.93 AND lon BETWEEN -74.27 AND -73.68)) AS outside_bbox FROM ev GROUP BY ROLLUP (year(ts)))""")
def _(spark, d):
    return profile.coordinate_quality(events(spark, d), "ts", "lat", "lon")


SLOT_N = """WITH n AS (SELECT CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour_of_week, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT CAST(h AS INTEGER) AS hour_of_week, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][h // 24 + 1] || ' ' || lpad(CAST(h % 24 AS VARCHAR), 2, '0') || ':00' AS slot, coalesce(n, 0) AS n
  FROM (SELECT unnest(range(168)) AS h) LEFT JOIN n ON h = hour_of_week)
"""


def slots(spark, d):
    return profile.slot_distribution(table(spark, d, "events"), "ts")


@query("D6_slot_distribution", SLOT_N + "SELECT * FROM s")
def _(spark, d):
    return slots(spark, d)


@query("D6_extreme_slots", SLOT_N + """SELECT * FROM (SELECT *, 'top' AS kind FROM s ORDER BY n DESC, hour_of_week LIMIT 10)
UNION ALL SELECT * FROM (SELECT *, 'bottom' AS kind FROM s ORDER BY n, hour_of_week LIMIT 10)""")
def _(spark, d):
    return profile.extreme_slots(slots(spark, d))


@query("D6_slot_grid", SLOT_N + "SELECT CAST(hour_of_week // 24 AS INTEGER) AS day, " + ", ".join(
    f"CAST(sum(n) FILTER (hour_of_week % 24 = {h}) AS BIGINT) AS h{h:02d}" for h in range(24)) + " FROM s GROUP BY 1")
def _(spark, d):
    return profile.slot_grid(slots(spark, d))


@query("D6_slot_summary", SLOT_N + "SELECT min(n) AS min_n, arg_min(hour_of_week, (n, hour_of_week)) AS min_slot, median(n)::DOUBLE AS median_n, max(n) AS max_n, arg_min(hour_of_week, (-n, hour_of_week)) AS max_slot, CAST(sum(n) AS BIGINT) AS total FROM s")
def _(spark, d):
    return profile.slot_summary(slots(spark, d))


@query("D7_sparsity", """SELECT n_cells, annual / (168 * 12) / n_cells AS per_cell_slot_168, annual / (56 * 12) / n_cells AS per_cell_slot_56
FROM (SELECT avg(n) AS annual FROM (SELECT count(*) AS n FROM orders GROUP BY year(o_orderdate) ORDER BY year(o_orderdate) DESC LIMIT 2)), (VALUES (2000), (4000), (6000)) t(n_cells)""")
def _(spark, d):
    years = profile.yearly_volume(table(spark, d, "orders"), "o_orderdate")
    return profile.sparsity_table(years.orderBy(F.desc("year")).limit(2).agg(F.avg("n").alias("annual")))


@query("D8_top_values", """SELECT coalesce(v, '(null)') AS value, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM part) AS share
FROM (SELECT CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS v FROM part) GROUP BY 1 ORDER BY n DESC, value LIMIT 15""")
def _(spark, d):
    parts = table(spark, d, "part").select(F.when(F.col("p_size") <= 45, F.col("p_name")).alias("v"))
    return profile.top_values(parts, "v")


@query("D9_status_table", with_sql("seg") + "SELECT status, count(*) AS n, count(valid_to) AS n_with_end, min(valid_from) AS min_start, max(valid_from) AS max_start FROM seg GROUP BY status")
def _(spark, d):
    return profile.status_table(segments(spark, d), "status", "valid_from", "valid_to")


@query("D9_status_notes", with_sql("seg") + "SELECT status, 'ended without end date' AS note, count(*) - count(valid_to) AS affected FROM seg WHERE status = 'Retired' GROUP BY status HAVING count(*) <> count(valid_to)")
def _(spark, d):
    return profile.status_notes(profile.status_table(segments(spark, d), "status", "valid_from", "valid_to"), "status")


@query("D10_week_convention", "SELECT dayofweek(ts) AS dow, count(*) AS n, 'all' AS scope FROM events WHERE isodow(ts) = 1 GROUP BY 1")
def _(spark, d):
    monday = table(spark, d, "events").where(F.weekday("ts") == 0)
    none = monday.where("event_type = 'refund'")  # the target has no rows, so all rows decide
    return profile.convention_counts(none, monday, F.dayofweek("ts") - 1)


@query("D11_reconcile", "SELECT (SELECT count(*) FROM orders) AS total_a, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS total_b, (SELECT count(*) FROM orders) - (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS difference, (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS agree")
def _(spark, d):
    return profile.reconcile(table(spark, d, "orders").agg(F.count("*").alias("total")),
                             table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("total")))


@query("D11_source_coverage", "SELECT l_returnflag, count(*) AS n, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return profile.source_coverage(table(spark, d, "lineitem"), "l_returnflag", "l_shipdate")


@query("D12_column_gaps", """SELECT 'o_comment' AS name, 'not observed' AS problem WHERE (SELECT count(*) FROM orders) > 0 UNION ALL SELECT 'o_clerk', 'not observed'
UNION ALL SELECT 'o_totalprice', 'not expected' WHERE (SELECT count(o_totalprice) FROM orders) > 0""")
def _(spark, d):
    expected = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_comment", "o_clerk"]
    return profile.column_gaps(table(spark, d, "orders"), expected)


@query("D12_columns_by_role", with_sql("seg") + """SELECT name, role FROM (VALUES ('status', 'status', 'status'), ('ft_facility', 'facility type', 'facilit'), ('tf_facility', 'facility type', 'facilit')) v(name, role, pattern)
WHERE (SELECT count(status) FROM seg) > 0""")
def _(spark, d):
    return profile.columns_by_role(profile.observed_columns(segments(spark, d))).select("name", "role")


@query("D12_coordinate_columns", with_sql("ev") + "SELECT 'lat' AS name, 'double' AS type, count(lat) AS non_null FROM ev UNION ALL SELECT 'lon', 'double', count(lon) FROM ev")
def _(spark, d):
    return profile.coordinate_columns(profile.observed_columns(events(spark, d)))


@query("D13_network_summary", with_sql("seg", "bridge") + NETWORK + """, per AS (SELECT month, count(DISTINCT cell) AS c, count(*) AS n FROM net GROUP BY month)
SELECT (SELECT count(DISTINCT cell) FROM net) AS cells_ever, arg_min(c, month) AS cells_first_month, arg_max(c, month) AS cells_last_month, CAST(sum(n) AS BIGINT) AS cell_months, min(month) AS first_month, max(month) AS last_month FROM per""")
def _(spark, d):
    return summarize_network(network(spark, d))
