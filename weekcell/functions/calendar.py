"""Wall-clock calendar columns.

All event times are TIMESTAMP_NTZ: the local wall clock, never shifted. Only
``exposure`` (operators/panel.py) and the completeness rules convert zones.
Months are carried as one integer ``year * 12 + month - 1`` wherever they are
joined or windowed on, and as a 'yyyy-MM' label in results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SLOTS = 168
HOURS_PER_DAY = 24
LOCAL_ZONE = "America/New_York"
# fixed values: day names of the slot labels, Monday first
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# fixed values: inclusive month ranges of the temporal splits
SPLITS = {
    "train": ("2021-01", "2024-09"),
    "validate": ("2024-10", "2025-09"),
    "test": ("2025-10", "2026-09"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of_week(ts: Column | str) -> Column:
    """0 = Monday 00:00 ... 167 = Sunday 23:00 of the wall clock."""
    return F.weekday(_col(ts)) * HOURS_PER_DAY + F.hour(_col(ts))


def hour_of_week_from_parts(dow: Column | str, hour: Column | str, sunday_is_zero: bool) -> Column:
    """Slot from a day number and an hour in either week convention; out-of-range parts fail."""
    dow, hour = _col(dow), _col(hour)
    day = F.pmod(dow - 1, F.lit(7)) if sunday_is_zero else dow
    in_range = dow.between(0, 6) & hour.between(0, 23)
    return F.when(in_range, day * HOURS_PER_DAY + hour).otherwise(
        F.raise_error(F.concat(F.lit("day or hour out of range: "), dow.cast("string"),
                               F.lit(", "), hour.cast("string"))).cast("int"))


def month_index(ts: Column | str) -> Column:
    return F.year(_col(ts)) * 12 + F.month(_col(ts)) - 1


def label_index(label: Column | str) -> Column:
    """'yyyy-MM' -> month index."""
    label = _col(label)
    return F.substring(label, 1, 4).cast("int") * 12 + F.substring(label, 6, 2).cast("int") - 1


def index_label(idx: Column | str) -> Column:
    """Month index -> 'yyyy-MM'."""
    idx = _col(idx)
    return F.concat(F.lpad(F.floor(idx / 12).cast("string"), 4, "0"), F.lit("-"),
                    F.lpad((F.pmod(idx, F.lit(12)) + 1).cast("string"), 2, "0"))


def month_label(ts: Column | str) -> Column:
    """'yyyy-MM' of a wall-clock time or date, read off its text form: no zone is involved."""
    return F.substring(_col(ts).cast("string"), 1, 7)


def month_start(idx: Column | str) -> Column:
    """First instant of a month index, as a wall-clock timestamp."""
    return F.concat(index_label(idx), F.lit("-01")).cast("timestamp_ntz")


def month_of_year(idx: Column | str) -> Column:
    return F.pmod(_col(idx), F.lit(12)) + 1


def day_of_week(slot: Column | str) -> Column:
    return F.floor(_col(slot) / HOURS_PER_DAY).cast("int")


def hour_of_day(slot: Column | str) -> Column:
    return F.pmod(_col(slot), F.lit(HOURS_PER_DAY)).cast("int")


def months_between_calendar(later_idx: Column | str, ts: Column | str) -> Column:
    """Age in whole calendar months: month numbers only, days ignored."""
    return _col(later_idx) - month_index(ts)


def split_name(label: Column | str, splits: dict[str, tuple[str, str]] = SPLITS) -> Column:
    """Name of the split whose inclusive month range holds the label; null outside all."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(splits.items())):
        out = F.when(_col(label).between(lo, hi), F.lit(name)).otherwise(out)
    return out


def slot_label(slot: Column | str) -> Column:
    """8 -> 'Mon 08:00'."""
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return F.concat(F.element_at(names, day_of_week(slot) + 1), F.lit(" "),
                    F.lpad(hour_of_day(slot).cast("string"), 2, "0"), F.lit(":00"))


def parse_slot(day: Column | str, hour: Column | str) -> Column:
    """Day name (any case, only its first three letters count) and hour -> slot; null when invalid."""
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    pos = F.array_position(names, F.initcap(F.substring(_col(day), 1, 3)))
    hour = _col(hour)
    return F.when((pos > 0) & hour.between(0, 23), ((pos - 1) * HOURS_PER_DAY + hour).cast("int"))


def month_spine(bounds: DataFrame, lo: str = "lo", hi: str = "hi", name: str = "month_idx") -> DataFrame:
    """One row per month index of the inclusive range(s) in ``bounds``."""
    return bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi))).alias(name))


def month_span(df: DataFrame, ts: str) -> DataFrame:
    """One row (lo, hi): first and last month index of a time column."""
    return df.agg(F.min(month_index(ts)).alias("lo"), F.max(month_index(ts)).alias("hi"))


def month_chunks(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Cut half-open date ranges at calendar-month borders; first and last chunk may be partial."""
    first = F.trunc(F.col(start), "MM")
    m = F.explode(F.sequence(first, F.date_sub(F.col(end), 1), F.expr("interval 1 month")))
    return (ranges.where(F.col(start) < F.col(end)).withColumn("_m", m)
            .withColumn("lo", F.greatest(F.col("_m"), F.col(start)))
            .withColumn("hi", F.least(F.add_months(F.col("_m"), 1), F.col(end)))
            .drop("_m"))


def overlap_start(latest_label: Column | str, overlap: int = 2) -> Column:
    """First month to pull again: the latest stored month and the ``overlap - 1`` before it."""
    return index_label(label_index(latest_label) - (overlap - 1))


def is_complete(month_idx: Column | str, pulled_at: Column | str, grace_days: int = 3) -> Column:
    """True once the month ended ``grace_days`` full local days before the (UTC) pull."""
    local_day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), _col(pulled_at).cast("timestamp_ntz")))
    return F.date_add(F.to_date(month_start(_col(month_idx) + 1)), grace_days) <= local_day
