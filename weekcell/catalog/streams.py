"""T: incremental and streaming forms. Streams read the given tables as files and drain what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcell.catalog.inputs import table, with_sql
from weekcell.catalog.registry import query
from weekcell.catalog.scans import MERGED, NOW, PULLS, as_requests, first_pull, order_months, second_pull
from weekcell.catalog.stages import scratch
from weekcell.functions.calendar import is_complete, label_index, month_label, overlap_start
from weekcell.session import configure
from weekcell.sources import readers, store
from weekcell.streaming import live


def event_stream(spark, d):
    """The events table as a file stream, one cell per eight users."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select("event_id", "ts", F.concat(F.lit("c"), F.floor(F.col("user_id") / 8).cast("string")).alias("cell"))


def drained(df, name: str, spark):
    """Run a streaming frame over everything available and read back what it wrote."""
    out = scratch(spark, name)
    q = (df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


@query("T1_late_data", PULLS + f"""SELECT month, count(*) AS n, count(*) FILTER (descriptor = 'F') AS closed FROM (SELECT *, strftime(created_date, '%Y-%m') AS month FROM ({MERGED}))
WHERE month >= '2000-11' GROUP BY month""")
def _(spark, d):
    # each run pulls the last two stored months again, so late changes to them arrive
    old, new = first_pull(spark, d), second_pull(spark, d)
    start = old.agg(overlap_start(F.max(month_label("created_date")), overlap=2).alias("m"))
    again = new.where(month_label("created_date") >= start.scalar())
    merged = store.merge_newest(old, again).transform(readers.with_month)
    return merged.where(F.col("month") >= start.scalar()).groupBy("month").agg(
        F.count("*").alias("n"), F.count_if(F.col("descriptor") == "F").alias("closed"))


@query("T2_publication_lag", """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) FILTER (CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) + 3 <= DATE '2001-08-31') = count(*) AS complete FROM lineitem GROUP BY 1""")
def _(spark, d):
    m = table(spark, d, "lineitem").select(month_label("l_shipdate").alias("month")).distinct()
    return m.select("month", is_complete(label_index("month"), F.lit("2001-09-01 03:00:00").cast("timestamp_ntz")).alias("complete"))


@query("T4_incremental_refresh", PULLS + "SELECT *, strftime(created_date, '%Y-%m') AS month FROM (" + MERGED + ")")
def _(spark, d):
    configure(spark)
    path = scratch(spark, "live")
    months = [m for m in order_months(spark, d) if m < "2001-01"]
    store.ingest_rows(spark, path, first_pull(spark, d), months, NOW)
    # the second pull arrives as files; the stream drains them into the store
    feed = scratch(spark, "feed")
    second_pull(spark, d).write.parquet(feed)
    stream = spark.readStream.schema(as_requests(spark, d).schema).parquet(feed)
    live.upsert_stream(stream, path, scratch(spark, "offsets"), now=NOW).awaitTermination()
    return readers.read_store(spark, path)


@query("T5_live_incidents", with_sql("inc", recursive=True) + "SELECT cell, start, n_events FROM inc")
def _(spark, d):
    # the feed ends with a row of no cell, a day past the last event: it closes what is open
    last = scratch(spark, "last")
    table(spark, d, "events").agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        F.lit(None).cast("string").alias("cell"), "ts").write.parquet(last)
    feed = event_stream(spark, d).select("cell", "ts")
    with live.state_store(spark):
        return drained(live.live_incidents(feed.union(spark.readStream.schema(feed.schema).parquet(last))), "windows", spark)


@query("T6_live_slot_counts", with_sql("ev") + """SELECT cell, date_trunc('hour', ts) AS hour_start, strftime(ts, '%Y-%m') AS month, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour_of_week, count(*) AS n
FROM ev WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 15 MINUTE FROM ev) GROUP BY ALL""")
def _(spark, d):
    out = drained(live.hourly_counts(event_stream(spark, d)), "hours", spark)
    return out.withColumn("hour_of_week", F.col("hour_of_week").cast("int"))
