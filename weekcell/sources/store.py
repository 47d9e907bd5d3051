"""Month-partitioned store: idempotent upserts, guards, control table, run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekcell.functions.calendar import index_label, is_complete, label_index, month_label, month_spine
from weekcell.operators.scale import assert_empty, first_row
from weekcell.session import cut_lineage
from weekcell.sources import versions

LINEAGE = ("source_dataset", "ingested_at", "month")


def merge_newest(existing: DataFrame, new: DataFrame, key: str = "unique_key") -> DataFrame:
    """Upsert: the new pull's row wins, rows the source no longer shows are kept."""
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def change_counts(existing: DataFrame, new: DataFrame, content: list[str], key: str = "unique_key",
                  by: list[str] | None = None) -> DataFrame:
    """fetched, new, updated, missing_from_source, rows; a value turning null is an update.

    Content is compared as one struct, null-safe, in a single full join on the key.
    """
    by = by or []
    old = existing.select(key, *[F.col(c).alias(f"_old_{c}") for c in by], F.struct(*content).alias("_old"))
    fresh = new.select(key, *by, F.struct(*content).alias("_new"))
    both = old.join(fresh, key, "full_outer")
    group = [F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in by]
    was, is_ = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return both.groupBy(*group).agg(
        F.count_if(is_).alias("fetched"), F.count_if(is_ & ~was).alias("new"),
        F.count_if(is_ & was & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("updated"),
        F.count_if(was & ~is_).alias("missing_from_source"), F.count("*").alias("rows"))


def duplicate_keys(df: DataFrame, key: str = "unique_key") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def stray_rows(df: DataFrame, months: list[str], ts: str = "created_date") -> DataFrame:
    """Rows whose time lies outside the requested months."""
    return df.where(~F.coalesce(month_label(ts).isin(months), F.lit(False)))


def write_months(df: DataFrame, path: str, mode: str = "overwrite", sort: list[str] | None = None) -> None:
    """Replace exactly the months present in ``df``; other partitions stay as they are.

    Rows of a month are spread over several files by the sort columns' range, so
    one heavy month is not one task.
    """
    out = df
    if sort:
        out = df.repartitionByRange("month", *sort).sortWithinPartitions("month", *sort)
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def ingest_rows(spark: SparkSession, path: str, new: DataFrame, months: list[str], now: datetime,
                ts: str = "created_date", key: str = "unique_key", store: str = "events") -> DataFrame:
    """Upsert one pull of some months into the store; returns the per-month change counts.

    The pull is evaluated once and checked first (no key twice, no row outside the months). Only the touched months
    are read; their new version is written beside the old one and then named in the manifest.
    """
    pull = cut_lineage(new.withColumn("month", month_label(ts)))
    assert_empty(stray_rows(pull, months, ts), "rows outside the requested months")
    assert_empty(duplicate_keys(pull, key), "key more than once in a pull")
    content = [c for c in new.columns if c not in (key, *LINEAGE)]
    base = versions.current(spark, path)
    old = versions.read_versions(spark, path, base, months) if base else pull.limit(0)
    missing = [F.lit(None).cast(pull.schema[c].dataType).alias(c) for c in pull.columns if c not in old.columns]
    stats = cut_lineage(change_counts(old.select("*", *missing), pull, content, key, by=["month"]))
    merged = merge_newest(old, pull, key)
    versions.publish(spark, path, versions.write_pull(merged, path, [ts, key]), merged.schema, months, base, now)
    spine = spark.createDataFrame([(m,) for m in months], "month string")
    done = with_all_months(stats, spine)
    update_control(spark, path + "_control", control_rows(done, store, now))
    return done


def ingest_grid(spark: SparkSession, path: str, grid: DataFrame, months: list[str], now: datetime,
                store: str = "background") -> DataFrame:
    """Replace whole months of grid counts; returns per-month totals.

    A requested month without rows in the pull is emptied; rows outside the requested months fail.
    """
    grid = cut_lineage(grid)
    assert_empty(grid.where(~F.coalesce(F.col("month").isin(months), F.lit(False))), "rows outside the requested months")
    versions.replace_months(spark, path, grid, months, now, sort=["grid_lat", "grid_lon"])
    per = grid.groupBy("month").agg(
        F.count_if(F.col("grid_lat").isNotNull()).alias("cells"), F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("grid_lat").isNull(), F.col("n"))), F.lit(0)).alias("no_location"))
    spine = spark.createDataFrame([(m,) for m in months], "month string")
    done = spine.join(per, "month", "left").na.fill(0)
    update_control(spark, path + "_control", control_rows(done, store, now))
    return done


def with_all_months(stats: DataFrame, months: DataFrame) -> DataFrame:
    """Stats row for every requested month, also those without rows."""
    return months.join(stats, "month", "left").na.fill(0)


def control_rows(stats: DataFrame, store: str, now: datetime | Column) -> DataFrame:
    pulled = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return stats.select(F.lit(store).alias("store"), "month", pulled.alias("pulled_at"),
                        is_complete(label_index("month"), pulled).alias("complete"), F.col("rows").cast("bigint"))


def update_control(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append; readers take the newest row per store and month."""
    rows.write.mode("append").json(path)


def read_control(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("store string, month string, pulled_at timestamp, complete boolean, rows bigint").json(path)
    return raw.groupBy("store", "month").agg(F.max_by(F.struct("pulled_at", "complete", "rows"), "pulled_at").alias("_r")) \
        .select("store", "month", "_r.*")


def build_range(control: DataFrame, first: str) -> DataFrame:
    """One row (lo, hi): from ``first`` to the last month complete in every store."""
    per_store = control.where("complete").groupBy("store").agg(F.max("month").alias("last"))
    return per_store.agg(F.lit(first).alias("lo"), F.min("last").alias("hi"))


def incomplete_months(control: DataFrame, first: str, at_least: str | None = None) -> DataFrame:
    """(store, month) inside the build range that no store row marks complete; expected empty."""
    end = build_range(control, first).select(
        label_index("lo").alias("lo"),
        F.greatest(label_index("hi"), label_index(F.lit(at_least)) if at_least else label_index("hi")).alias("hi"))
    months = month_spine(end).select(index_label("month_idx").alias("month"))
    stores = control.select("store").distinct()
    # Months of the calendar for each store: both sides are control-table sized.
    wanted = stores.withColumn("_m", F.explode(months.agg(F.collect_list("month").alias("m")).scalar()))
    return wanted.select("store", F.col("_m").alias("month")).join(
        control.where("complete").select("store", "month"), ["store", "month"], "left_anti")


def check_build_range(control: DataFrame, first: str, at_least: str | None = None) -> tuple[str, str]:
    assert_empty(incomplete_months(control, first, at_least), "months missing or incomplete")
    row = build_range(control, first).first()
    if row["hi"] is None:
        raise ValueError("no complete months")
    return row["lo"], row["hi"]


def append_run_log(path: str, counters: DataFrame) -> None:
    """One JSON row of counters per run."""
    counters.withColumn("run_at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def unprocessed(files: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Files without a finished part."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def pull_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        *[F.sum(c).alias(c) for c in ("fetched", "new", "updated", "missing_from_source")])


def newest_rows(df: DataFrame, key: str, pulled: str) -> DataFrame:
    """Upsert over an append-only log: the row with the latest pull per key."""
    rest = [c for c in df.columns if c not in (key, pulled)]
    flipped = df.withColumn("_age", -F.unix_micros(F.col(pulled).cast("timestamp")))
    return first_row(flipped, [key], ["_age"], [pulled, *rest]).select(*df.columns)
