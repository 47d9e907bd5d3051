"""Data-quality profiles; table and column names are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from weekcell.functions.calendar import SLOTS, hour_of_week, label_index, index_label, month_label, month_spine, slot_label
from weekcell.functions.predicates import contains_either, in_bbox, mentions_all
from weekcell.operators.panel import complete_series
from weekcell.operators.scale import exact_quantiles
from weekcell.operators.trailing import month_changes

# fixed values: cell counts of the sparsity table
SPARSITY_CELLS = [2000, 4000, 6000]
# fixed values: type names and name pattern of coordinate-like columns
POINT_TYPES = ["point", "multipoint", "location", "line", "multiline", "polygon", "multipolygon"]
COORDINATE_NAME = r"(?i)(^|_)(lat|latitude|lon|lng|longitude|the_geom|geom|point|georeference|x_coord|y_coord)($|_)"
# fixed values: name patterns by role
ROLE_PATTERNS = {"facility type": r"facilit|allclasses", "install date": r"inst|install",
                 "retire date": r"ret_?date|retire", "status": r"^status$"}


def pair_counts(df: DataFrame, a: str, b: str, ts: str, source: str) -> DataFrame:
    """(source, a, b, n, first, last): the cheap grouped pass all pair profiles start from."""
    return df.groupBy(source, a, b).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def merge_pair_counts(counts: DataFrame, a: str, b: str, source: str, sources: list[str]) -> DataFrame:
    """Totals over sources, one count column per source, earliest first and latest last; a null reads as ''."""
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in (a, b)]
    per = [F.coalesce(F.sum(F.when(F.col(source) == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in sources]
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("first").alias("first_seen"),
                                     F.max("last").alias("last_seen"), *per)


def matching_pairs(counts: DataFrame, a: str, b: str, pattern: str) -> DataFrame:
    return counts.where(contains_either(a, b, pattern))


def plausible_pairs(merged: DataFrame, a: str, b: str, words: list[str]) -> DataFrame:
    return merged.where(mentions_all(a, b, words)).orderBy(F.desc("total"), a, b)


def choose_target(merged: DataFrame, a: str, b: str, words: list[str]) -> DataFrame:
    """The most frequent plausible pair; no row when none qualifies."""
    return plausible_pairs(merged, a, b, words).limit(1)


def sum_grouped(frames: list[DataFrame], keys: list[str], value: str = "n") -> DataFrame:
    """Stack grouped counts and add them by keys; null keys stay a group."""
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    return stacked.groupBy(*keys).agg(F.sum(value).alias(value))


def yearly_volume(df: DataFrame, ts: str) -> DataFrame:
    """(year, n) on the full span of years."""
    counts = df.groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("n"))
    spine = counts.agg(F.sequence(F.min("year"), F.max("year")).alias("ys")).select(F.explode("ys").alias("year"))
    return spine.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_series(df: DataFrame, ts: str) -> DataFrame:
    counts = df.groupBy(month_label(ts).alias("month")).agg(F.count("*").alias("n"))
    bounds = counts.agg(label_index(F.min("month")).alias("lo"), label_index(F.max("month")).alias("hi"))
    return complete_series(counts, month_spine(bounds).select(index_label("month_idx").alias("month")))


def largest_changes(series: DataFrame, k: int = 5) -> DataFrame:
    """The k largest drops and rises of a month series."""
    changes = month_changes(series)
    drops = changes.where(F.col("change") < 0).orderBy("change", "month").limit(k).withColumn("kind", F.lit("drop"))
    rises = changes.where(F.col("change") > 0).orderBy(F.desc("change"), "month").limit(k).withColumn("kind", F.lit("rise"))
    return drops.unionByName(rises)


def coordinate_quality(df: DataFrame, ts: str, lat: str, lon: str, box: dict | None = None) -> DataFrame:
    """(year, rows, null_latlon, outside_bbox, shares) with a grand-total row whose year is null."""
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    inside = in_bbox(lat, lon, box) if box else in_bbox(lat, lon)
    return (df.rollup(F.year(ts).alias("year")).agg(
        F.count("*").alias("rows"), F.count_if(missing).alias("null_latlon"),
        F.count_if(~missing & ~inside).alias("outside_bbox"))
        .withColumn("null_share", F.round(F.col("null_latlon") / F.col("rows"), 6))
        .withColumn("outside_share", F.round(F.col("outside_bbox") / F.col("rows"), 6)))


def slot_distribution(df: DataFrame, ts: str) -> DataFrame:
    """(hour_of_week, slot, n) on all 168 slots, zeros kept."""
    counts = df.groupBy(hour_of_week(ts).alias("hour_of_week")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("hour_of_week"))
    return spine.join(counts, "hour_of_week", "left").select(
        "hour_of_week", slot_label("hour_of_week").alias("slot"), F.coalesce("n", F.lit(0)).alias("n"))


def extreme_slots(slots: DataFrame, k: int = 10) -> DataFrame:
    top = slots.orderBy(F.desc("n"), "hour_of_week").limit(k).withColumn("kind", F.lit("top"))
    bottom = slots.orderBy("n", "hour_of_week").limit(k).withColumn("kind", F.lit("bottom"))
    return top.unionByName(bottom)


def slot_grid(slots: DataFrame) -> DataFrame:
    """7 x 24 grid: one row per day, one column per hour."""
    return (slots.withColumn("day", F.floor(F.col("hour_of_week") / 24).cast("int"))
            .withColumn("hour", F.pmod("hour_of_week", F.lit(24)))
            .groupBy("day").pivot("hour", list(range(24))).agg(F.sum("n"))
            .withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)}))


def slot_summary(slots: DataFrame) -> DataFrame:
    """One row: smallest, median and largest slot (168 rows in, so the built-in percentile is small)."""
    return slots.agg(F.min("n").alias("min_n"), F.min_by("hour_of_week", F.struct("n", "hour_of_week")).alias("min_slot"),
                     F.percentile("n", F.lit(0.5)).alias("median_n"), F.max("n").alias("max_n"),
                     F.min_by("hour_of_week", F.struct(-F.col("n"), F.col("hour_of_week"))).alias("max_slot"),
                     F.sum("n").alias("total"))


def sparsity_table(annual: DataFrame, cells: list[int] = SPARSITY_CELLS, slots: tuple[int, ...] = (168, 56)) -> DataFrame:
    """Expected events per cell, slot and month if the annual count (one row, column 'annual') were spread evenly."""
    per = [(F.col("annual") / (s * 12) / F.col("n_cells")).alias(f"per_cell_slot_{s}") for s in slots]
    return annual.withColumn("n_cells", F.explode(F.array(*[F.lit(c) for c in cells]))).select("n_cells", *per)


def top_values(df: DataFrame, column: str, k: int = 15, null_label: str = "(null)") -> DataFrame:
    """Most frequent values with their share of all rows."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(null_label)).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return (counts.orderBy(F.desc("n"), "value").limit(k)
            .withColumn("share", F.col("n") / total.scalar()))


def status_table(df: DataFrame, status: str, start: str, end: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"), F.count(end).alias("n_with_end"),
                                  F.min(start).alias("min_start"), F.max(start).alias("max_start"))


def status_notes(table: DataFrame, status: str, retired: str = "retired") -> DataFrame:
    """Statuses whose end dates contradict them."""
    is_retired = F.lower(status) == retired
    return (table.withColumn("note", F.when(is_retired & (F.col("n") != F.col("n_with_end")), "ended without end date")
                             .when(~is_retired & (F.col("n_with_end") > 0), "end date although not ended"))
            .withColumn("affected", F.when(is_retired, F.col("n") - F.col("n_with_end")).otherwise(F.col("n_with_end")))
            .where(F.col("note").isNotNull()).select(status, "note", "affected"))


def day_convention(dow_counts: DataFrame) -> DataFrame:
    """One row: True when a single Monday shows as day 1 (Sunday is 0), False as day 0; else an error."""
    seen = dow_counts.where(F.col("n") > 0).agg(F.array_sort(F.collect_set(F.col("dow").cast("int"))).alias("v"))
    return seen.select(F.when(F.col("v") == F.array(F.lit(1)), True).when(F.col("v") == F.array(F.lit(0)), False)
                       .otherwise(F.raise_error(F.lit("ambiguous day numbers for one Monday")).cast("boolean"))
                       .alias("sunday_is_zero"))


def convention_counts(target: DataFrame, everything: DataFrame, dow) -> DataFrame:
    """Day-number counts of the target rows, or of all rows when the target has none."""
    count = lambda df, scope: df.groupBy(dow.alias("dow")).agg(F.count("*").alias("n")).withColumn("scope", F.lit(scope))
    both = count(target, "target").unionByName(count(everything, "all"))
    n_target = target.agg(F.count("*").alias("n"))
    return both.where(F.col("scope") == F.when(n_target.scalar() > 0, "target").otherwise("all"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: two one-row totals ('total' columns), their difference and whether they agree."""
    return a.select(F.col("total").alias("total_a"), b.select("total").scalar().alias("total_b")).withColumn(
        "difference", F.col("total_a") - F.col("total_b")).withColumn("agree", F.col("difference") == 0)


def source_coverage(df: DataFrame, source: str, ts: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def observed_columns(df: DataFrame) -> DataFrame:
    """(name, type, non_null): every column with its number of non-null values."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    wide = counts.select(F.explode(F.array(*[F.struct(
        F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`").alias("non_null"))
        for f in df.schema])).alias("c"))
    return wide.select("c.*")


def column_gaps(df: DataFrame, expected: list[str]) -> DataFrame:
    """Expected columns that are absent or never filled, and filled columns nobody expects."""
    seen = observed_columns(df).where(F.col("non_null") > 0).select("name")
    want = df.sparkSession.createDataFrame([(c,) for c in expected], "name string")
    return (want.exceptAll(seen).withColumn("problem", F.lit("not observed"))
            .unionByName(seen.exceptAll(want).withColumn("problem", F.lit("not expected"))))


def coordinate_columns(columns: DataFrame) -> DataFrame:
    """Coordinate-like columns of a (name, type) frame."""
    return columns.where(F.lower(F.coalesce("type", F.lit(""))).isin(POINT_TYPES) | F.col("name").rlike(COORDINATE_NAME))


def columns_by_role(columns: DataFrame) -> DataFrame:
    """(role, name) of the columns whose name fits a role."""
    role = F.explode(F.array_compact(F.array(*[
        F.when(F.lower("name").rlike(p), F.lit(r)) for r, p in ROLE_PATTERNS.items()]))).alias("role")
    return columns.select(role, "name")


def newest_by_suffix(names: DataFrame, pattern: str) -> DataFrame:
    """The row whose name fits the pattern with the largest captured number; no row when none fits."""
    number = F.regexp_extract("name", pattern, 1).try_cast("int")
    return names.withColumn("number", number).where(F.col("number").isNotNull()).orderBy(F.desc("number"), "name").limit(1)


def value_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: key of the smallest value, exact median, key of the largest value."""
    ends = df.agg(F.min_by(key, F.struct(value, key)).alias("min_key"), F.min(value).alias("min_value"),
                  F.max(value).alias("max_value"),
                  F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("max_key"))
    return ends.withColumn("median_value", exact_quantiles(df, value, [0.5], "q").select(F.col("q")[0].alias("q")).scalar())


def category_counts(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Counts on a fixed category list; absent categories are 0."""
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return spine.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
