"""Level recalibration: observed over predicted in trailing windows, by month or by week."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from weekcell.functions.calendar import day_of_week, label_index, month_label
from weekcell.operators.trailing import trailing_ratio

WINDOW_MONTHS = 3
WINDOW_DAYS = 56
LAG_DAYS = 2


def monthly_totals(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("month").agg(F.sum("y").alias("observed"), F.sum("mu").alias("predicted"))
            .withColumn("month_idx", label_index("month")))


def monthly_factor(rows: DataFrame, window: int = WINDOW_MONTHS) -> DataFrame:
    """(month, observed, predicted, factor) from the months strictly before."""
    return trailing_ratio(monthly_totals(rows), window)


def _require(df: DataFrame, column: str, message: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(column, F.raise_error(F.lit(message)).cast("double")))


def apply_monthly(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Scale mu by the month's factor; a month without one fails."""
    f = factors.where(F.col("factor").isNotNull()).select("month", F.col("factor").alias("_f"))
    scaled = _require(rows.join(F.broadcast(f), "month", "left"), "_f", "no recalibration factor for a month")
    return scaled.withColumn("mu", F.col("mu") * F.col("_f")).drop("_f")


def day_spine(months: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last month of a 'month' column."""
    ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    lo = F.to_date(F.concat("a", F.lit("-01")))
    hi = F.last_day(F.to_date(F.concat("b", F.lit("-01"))))
    return ends.select(F.explode(F.sequence(lo, hi)).alias("day"))


def daily_totals(rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """(day, observed, predicted).

    Predicted for a day is the month's summed hourly rate of that weekday's 24
    slots (24 hours also on clock-change days). Observed are incidents starting
    that day in (cell, month) blocks that have rows.
    """
    used = rows.where(F.col("exposure") > 0)
    rate = (used.groupBy("month", day_of_week("hour_of_week").alias("dow"))
            .agg(F.sum(F.col("mu") / F.col("exposure")).alias("predicted")))
    days = day_spine(used.select("month")).withColumn("month", month_label("day")).withColumn("dow", F.weekday("day"))
    blocks = used.select("cell", "month").distinct()
    observed = (incidents.join(blocks, ["cell", "month"], "left_semi").groupBy(F.to_date("start").alias("day"))
                .agg(F.count("*").alias("observed")))
    return (days.join(rate, ["month", "dow"], "left").join(observed, "day", "left")
            .select("day", F.coalesce("observed", F.lit(0)).cast("double").alias("observed"),
                    F.coalesce("predicted", F.lit(0.0)).alias("predicted")))


def trailing_day_factors(daily: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(day, factor, covered): observed over predicted of the window ending that day; covered = days present."""
    # One row per calendar day, so the unpartitioned window is as long as the calendar.
    frame = Window.orderBy("_n").rangeBetween(-(window_days - 1), 0)
    numbered = daily.withColumn("_n", F.unix_date("day"))
    return numbered.select(
        "day", F.try_divide(F.sum("observed").over(frame), F.sum("predicted").over(frame)).alias("factor"),
        F.count("*").over(frame).alias("covered"))


def weekly_factor(daily: DataFrame, days: DataFrame, window_days: int = WINDOW_DAYS, lag_days: int = LAG_DAYS) -> DataFrame:
    """(day, factor) in force on each day, refreshed on Mondays; an uncovered window fails."""
    monday = F.date_sub("day", F.weekday("day"))
    ends = days.select("day").withColumn("_end", F.date_sub(monday, lag_days))
    windows = (trailing_day_factors(daily, window_days).where(F.col("covered") == window_days)
               .select(F.col("day").alias("_end"), "factor"))
    out = ends.join(windows, "_end", "left").drop("_end")
    return _require(out, "factor", "recalibration window is not covered by daily totals")


def apply_weekly(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Scale mu by the mean factor over the occurrences of the row's weekday in its month."""
    per = factors.groupBy(month_label("day").alias("month"), F.weekday("day").alias("_dow")).agg(F.avg("factor").alias("_f"))
    keyed = rows.withColumn("_dow", day_of_week("hour_of_week")).join(F.broadcast(per), ["month", "_dow"], "left")
    scaled = _require(keyed, "_f", "no recalibration factor for a month and weekday")
    return scaled.withColumn("mu", F.col("mu") * F.col("_f")).drop("_f", "_dow")


def factor_as_of(daily: DataFrame, as_of: str, window_days: int = WINDOW_DAYS, lag_days: int = LAG_DAYS) -> DataFrame:
    """One row (window_start, window_end, observed, predicted, factor) of the window ending ``lag_days`` before."""
    end = F.date_sub(F.to_date(F.lit(as_of)), lag_days)
    start = F.date_sub(end, window_days - 1)
    one = daily.where(F.col("day").between(start, end)).agg(
        start.alias("window_start"), end.alias("window_end"), F.count("*").alias("days"),
        F.sum("observed").alias("observed"), F.sum("predicted").alias("predicted"))
    ratio = F.when(F.col("days") == window_days, F.col("observed") / F.col("predicted")).otherwise(
        F.raise_error(F.lit("recalibration window is not covered by daily totals")).cast("double"))
    return one.withColumn("factor", ratio).drop("days")


def serving_factor(prior: DataFrame, serving: DataFrame, incidents: DataFrame, month: str, as_of: str,
                   window_days: int = WINDOW_DAYS, lag_days: int = LAG_DAYS) -> DataFrame:
    """The factor of ``factor_as_of`` for a table that serves ``month``, whose window may reach into that month.

    ``prior`` holds predicted rows of earlier months, as they were stored; days of the serving month come from ``serving``, the rows that are about to be
    served. Rows of ``prior`` from the serving month on and rows of ``serving`` in other months are left out, so no day counts
    twice. An as-of date whose window ends after the serving month is refused.
    """
    end = date.fromisoformat(as_of) - timedelta(days=lag_days)
    start = end - timedelta(days=window_days - 1)
    last = f"{end:%Y-%m}"
    if last > month:
        raise ValueError(f"the window as of {as_of} ends in {last}, after the served month {month}")
    # the months of the window as two literals, so that the scan of the stored rows reads no others
    inside = F.col("month").between(f"{start:%Y-%m}", last)
    keep = ["cell", "month", "hour_of_week", "mu", "exposure"]
    rows = prior.where(inside & (F.col("month") < month)).select(keep).unionByName(serving.where(inside & (F.col("month") == month)).select(keep))
    return factor_as_of(daily_totals(rows, incidents), as_of, window_days, lag_days)
