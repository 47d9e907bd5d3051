"""Segments over time: which cells are on the network, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekcell.functions.calendar import index_label, month_index, months_between_calendar, month_start
from weekcell.functions.predicates import LANE_TYPES, active_at, active_in_month, in_scope, lane_type


def segment_months(segments: DataFrame, months: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(segment_id, month_idx) for every month a segment is valid from start to end.

    Validity is an interval, so each segment lists its own months between the
    bounds of the spine instead of being compared with every month.
    """
    bounds = months.agg(F.min("month_idx").alias("lo"), F.max("month_idx").alias("hi"))
    first = F.when(month_start(month_index("valid_from")) == F.col("valid_from"), month_index("valid_from")).otherwise(
        month_index("valid_from") + 1)
    last = F.coalesce(month_index("valid_to") - 1, F.col("_hi"))
    listed = (segments.where(F.col("usable") & F.col("valid_from").isNotNull())
              .withColumn("_lo", bounds.select("lo").scalar()).withColumn("_hi", bounds.select("hi").scalar())
              .withColumn("_first", F.greatest(first, F.col("_lo"))).withColumn("_last", F.least(last, F.col("_hi")))
              .where(F.col("_first") <= F.col("_last"))
              .withColumn("month_idx", F.explode(F.sequence("_first", "_last"))))
    out = listed.where(active_in_month(F.col("month_idx"))).select("segment_id", *(keep or []), "month_idx")
    return out.join(F.broadcast(months.select("month_idx").distinct()), "month_idx", "left_semi")


def in_cells(segments: DataFrame, bridge: DataFrame) -> DataFrame:
    """Segments with the columns of the bridge, one row for each cell. To be done before months are listed.

    The planner takes listed rows to be as few as the segments are, and would broadcast them through the driver; neither side is broadcast here.
    """
    return segments.join(bridge.hint("merge"), "segment_id")


def segments_at_month_start(segments: DataFrame, months: DataFrame) -> DataFrame:
    """Segment rows x the months at whose first instant they are valid (half-open)."""
    bounds = months.agg(F.min("month_idx").alias("lo"), F.max("month_idx").alias("hi"))
    starts_on = month_start(month_index("valid_from")) == F.col("valid_from")
    first = month_index("valid_from") + F.when(starts_on, 0).otherwise(1)
    last = F.coalesce(month_index("valid_to"), F.col("_hi"))
    listed = (segments.where(F.col("usable") & F.col("valid_from").isNotNull())
              .withColumn("_lo", bounds.select("lo").scalar()).withColumn("_hi", bounds.select("hi").scalar())
              .withColumn("_first", F.greatest(first, F.col("_lo"))).withColumn("_last", F.least(last, F.col("_hi")))
              .where(F.col("_first") <= F.col("_last"))
              .withColumn("month_idx", F.explode(F.sequence("_first", "_last"))).drop("_lo", "_hi", "_first", "_last"))
    return (listed.where(active_at(month_start("month_idx")))
            .join(F.broadcast(months.select("month_idx").distinct()), "month_idx", "left_semi"))


def network_cell_months(segments: DataFrame, bridge: DataFrame, months: DataFrame,
                        scope: str = "lanes_on_street") -> DataFrame:
    """(cell, month, n_segments) for every cell-month with a segment in scope valid all month."""
    lines = in_cells(segments.where(in_scope(scope)), bridge.select("segment_id", "cell"))
    return (segment_months(lines, months, ["cell"])
            .groupBy("cell", "month_idx").agg(F.count("*").alias("n_segments"))
            .select("cell", index_label("month_idx").alias("month"), "n_segments"))


def majority_category(pairs: DataFrame, key: str = "cell", category: str = "boro") -> DataFrame:
    """Most frequent category per key; ties go to the lower category."""
    counts = pairs.groupBy(key, category).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(category).alias("c")))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.c").alias(category))


def lane_features(rows: DataFrame, segments: DataFrame, bridge: DataFrame, scope: str = "lanes_on_street") -> DataFrame:
    """Rows (cell, month_idx) with lane metres by type, their total and the newest lane's age at month start."""
    typed = (segments.where(in_scope(scope)).withColumn("_type", lane_type())
             .select("segment_id", "usable", "valid_from", "valid_to", "_type"))
    pieces = segments_at_month_start(in_cells(typed, bridge.select("segment_id", "cell", "len_m")), rows.select("month_idx").distinct())
    metres = [F.coalesce(F.sum(F.when(F.col("_type") == t, F.col("len_m"))), F.lit(0.0)).alias(f"lane_m_{t}")
              for t in LANE_TYPES]
    per = pieces.groupBy("cell", "month_idx").agg(*metres, F.max("valid_from").alias("_newest"))
    per = per.select("cell", "month_idx", *[f"lane_m_{t}" for t in LANE_TYPES],
                     sum((F.col(f"lane_m_{t}") for t in LANE_TYPES), F.lit(0.0)).alias("lane_m_total"),
                     months_between_calendar("month_idx", "_newest").alias("newest_lane_age_months"))
    return rows.join(per, ["cell", "month_idx"], "left")


def summarize_network(network: DataFrame) -> DataFrame:
    """One row: cells ever, in the first and in the last month, and cell-months."""
    per_month = network.groupBy("month").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("n"))
    ends = per_month.agg(F.min_by("cells", "month").alias("cells_first_month"),
                         F.max_by("cells", "month").alias("cells_last_month"),
                         F.sum("n").alias("cell_months"), F.min("month").alias("first_month"),
                         F.max("month").alias("last_month"))
    ever = network.agg(F.count_distinct("cell").alias("cells_ever"))
    return ends.withColumn("cells_ever", ever.scalar())
