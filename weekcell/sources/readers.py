"""Scans: fixed schemas, layouts, routing over several sources, snapshots.

A source is any callable ``(spark) -> DataFrame``, so tests and callers can hand
in tables, files or queries alike. Filters and column lists are plain DataFrame
operations; Catalyst pushes them into the file scan.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekcell.functions import geo
from weekcell.functions.calendar import month_label
from weekcell.functions.predicates import exclude_reason, in_bbox, in_dates, is_not_target, is_target
from weekcell.operators.scale import assert_empty
from weekcell.operators.spatial import with_cell, with_metric
from weekcell.sources.schemas import (EVENT_COLUMNS, EVENT_NUMBERS, EVENT_TIMES, LINE_TEXT, LOT_COLUMNS, LOT_NUMBERS,
                                      TRIP_LAYOUTS, conform, event_schema, text_schema)
from weekcell.sources.versions import current, read_versions

Reader = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Coverage:
    """A source and the half-open date range it serves; a missing bound is open."""
    name: str
    read: Reader
    start: str | None = None
    end: str | None = None


def clip(coverage: Coverage, start: str | None, end: str | None) -> tuple[str | None, str | None] | None:
    """The part of [start, end) this source serves, or None."""
    lo = max([d for d in (start, coverage.start) if d], default=None)
    hi = min([d for d in (end, coverage.end) if d], default=None)
    return None if lo and hi and lo >= hi else (lo, hi)


def routed_scan(spark: SparkSession, sources: list[Coverage], start: str | None, end: str | None,
                ts: str = "created_date") -> DataFrame:
    """Each source read over its own part of the range, then stacked with its name."""
    parts = []
    for src in sources:
        span = clip(src, start, end)
        if span is not None:
            parts.append(src.read(spark).where(in_dates(ts, *span)).withColumn("source_dataset", F.lit(src.name)))
    if not parts:
        raise ValueError(f"no source covers [{start}, {end})")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def target_rows(events: DataFrame, pair: tuple[str, str], start: str | None, end: str | None) -> DataFrame:
    """Raw rows of the target pair in a date range, with the store's columns only."""
    return events.where(is_target("complaint_type", "descriptor", pair) & in_dates("created_date", start, end)).select(
        *[c for c in EVENT_COLUMNS if c in events.columns])


def background_grid(events: DataFrame, pair: tuple[str, str], start: str | None, end: str | None,
                    step: float = 0.002) -> DataFrame:
    """Counts of everything but the target on a coordinate grid; unlocated rows share the null cell."""
    return (events.where(is_not_target("complaint_type", "descriptor", pair) & in_dates("created_date", start, end))
            .groupBy(geo.snap_grid("latitude", step).alias("grid_lat"), geo.snap_grid("longitude", step).alias("grid_lon"))
            .agg(F.count("*").alias("n")))


def normalize_events(raw: DataFrame, source: str, ingested_at: Column | None = None) -> DataFrame:
    """Text rows -> event schema: ISO times, numbers, text, lineage columns. A malformed value fails."""
    have = set(raw.columns)
    text = raw.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in EVENT_COLUMNS])
    typed = [F.to_timestamp_ntz(c).alias(c) if c in EVENT_TIMES
             else F.col(c).cast("double").alias(c) if c in EVENT_NUMBERS
             else F.col(c).cast("string").alias(c) for c in EVENT_COLUMNS]
    return conform(text.select(*typed, F.lit(source).alias("source_dataset"),
                               (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at")),
                   event_schema())


def grid_from_geojson(rows: DataFrame, month: str, complete: bool, source: str) -> DataFrame:
    """Rows (g: GeoJSON point text or null, n) -> grid counts; the unlocated bucket sorts first."""
    point = F.from_json("g", "type string, coordinates array<double>")
    at = lambda i: F.round(point["coordinates"][i], 3)
    return rows.select(
        F.lit(month).alias("month"), at(1).alias("grid_lat"), at(0).alias("grid_lon"), F.col("n").cast("bigint"),
        F.lit(complete).alias("month_complete"), F.lit(source).alias("source_dataset"),
    ).orderBy(F.col("grid_lat").asc_nulls_first(), F.col("grid_lon").asc_nulls_first())


def normalize_lines(raw: DataFrame) -> DataFrame:
    """GeoJSON (multi)line rows -> typed attributes, validity, quality flag and ``points`` in metres.

    ``raw`` has route_id, the_geom (GeoJSON text) and any of the text and date
    columns as text; absent columns count as null.
    """
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    typed = raw.select(
        F.col("route_id").cast("string").alias("segment_id"), *[col(c).cast("string").alias(c) for c in LINE_TEXT],
        F.to_timestamp_ntz(col("instdate")).alias("valid_from"), F.to_timestamp_ntz(col("ret_date")).alias("valid_to"),
        F.get_json_object("the_geom", "$.type").alias("_kind"),
        F.get_json_object("the_geom", "$.coordinates").alias("_xy"))
    lonlat = F.when(F.col("_kind") == "LineString", F.array(F.from_json("_xy", "array<array<double>>"))).otherwise(
        F.from_json("_xy", "array<array<array<double>>>"))

    def metric(p: Column) -> Column:
        x, y = geo.to_metric(p[0], p[1])
        return F.struct(x.alias("x"), y.alias("y"))

    flagged = typed.withColumn("exclude_reason", exclude_reason()).withColumn(
        "usable", F.col("exclude_reason").isNull())
    return (flagged.withColumn("points", F.transform(lonlat, lambda part: F.transform(part, metric)))
            .drop("_kind", "_xy")
            .withColumnsRenamed({"facilitycl": "lane_class", "onoffst": "on_street", "ft_facilit": "ft_facility",
                                 "tf_facilit": "tf_facility"}))


# -- trip files ---------------------------------------------------------------


def trip_layout(header: list[str]) -> dict[str, str]:
    """Role -> actual header name; headers are compared trimmed and in lower case."""
    actual = {h.strip().lower(): h for h in header}
    for layout in TRIP_LAYOUTS:
        if set(layout.values()) <= set(actual):
            return {role: actual[name] for role, name in layout.items()}
    raise ValueError(f"unrecognised trip layout: {header}")


def unify_trips(frames: list[DataFrame]) -> DataFrame:
    """Text frames of either layout as one (started, ended, start and end coordinates)."""
    named = [df.select(*[F.col(f"`{name}`").alias(role) for role, name in trip_layout(df.columns).items()])
             for df in frames]
    return reduce(lambda a, b: a.unionByName(b), named)


def header_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(header, files): the files under ``paths`` by their first line, from one scan however many they are; empty files are left out.

    Only the first split of a file can hold its first line. Lines of a split stay in order, and what leaves a task is
    one line for each file in it.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    return first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def read_trips(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Trip files (or folders of them) of either layout as one text frame; an unknown layout fails.

    One scan finds the layouts; the files of a layout are then one source, split and read by the tasks. What the driver sees is a list of file names,
    which it has to list anyway, and one header for each layout.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in header_index(spark, paths).collect():
        header = tuple(next(csv.reader([row["header"].lstrip("\ufeff")]), []))
        groups.setdefault(header, []).extend(unquote(f) for f in row["files"])
    return unify_trips([spark.read.schema(text_schema(list(header))).option("header", True).csv(files)
                        for header, files in sorted(groups.items())])


def trip_ends(trips: DataFrame) -> DataFrame:
    """(kind, month, lat, lng, n): trip starts and ends by month and coordinate; null coordinates kept."""
    ends = F.explode(F.array(
        F.struct(F.lit("start").alias("kind"), F.substring("started", 1, 7).alias("month"),
                 geo.round_coord("start_lat").alias("lat"), geo.round_coord("start_lng").alias("lng")),
        F.struct(F.lit("end").alias("kind"), F.substring("ended", 1, 7).alias("month"),
                 geo.round_coord("end_lat").alias("lat"), geo.round_coord("end_lng").alias("lng"))))
    return trips.select(ends.alias("e")).groupBy("e.kind", "e.month", "e.lat", "e.lng").agg(F.count("*").alias("n"))


def trip_cells(ends: DataFrame) -> DataFrame:
    """(kind, month, cell, n) of the ends inside the city box."""
    inside = ends.where(in_bbox("lat", "lng"))
    return with_cell(with_metric(inside, "lng", "lat")).groupBy("kind", "month", "cell").agg(F.sum("n").alias("n"))


def trip_cell_months(cells: DataFrame) -> DataFrame:
    """(cell, month, starts, ends); a missing kind is 0."""
    wide = cells.groupBy("cell", "month").pivot("kind", ["start", "end"]).agg(F.sum("n"))
    return wide.select("cell", "month", F.coalesce("start", F.lit(0)).alias("starts"),
                       F.coalesce("end", F.lit(0)).alias("ends"))


# fixed value: name pattern of trip archives, monthly or yearly
ARCHIVE_PATTERN = r"^(\d{4})(\d{2})?-citibike-tripdata(\.csv)?\.(zip|csv|parquet)$"


def list_archives(files: DataFrame, from_year: int, path: str = "path") -> DataFrame:
    """Files whose base name is an archive of ``from_year`` or later, sorted."""
    base = F.element_at(F.split(path, "/"), -1)
    year = F.regexp_extract(base, ARCHIVE_PATTERN, 1)
    named = files.withColumn("name", base).withColumn("year", F.when(year != "", year.try_cast("int")))
    return named.where(F.col("year") >= from_year).orderBy("name")


def covered_through(names: DataFrame, name: str = "name") -> DataFrame:
    """One row: the last month with an archive of its own; yearly archives say nothing."""
    pattern = r"^(\d{4})(\d{2})-citibike-tripdata"
    hit = F.concat_ws("-", F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    return names.agg(F.max(F.when(F.regexp_extract(name, pattern, 2) != "", hit)).alias("covered"))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) without reading the contents."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length"))


# -- lots, snapshots, stores -------------------------------------------------------


def normalize_lots(raw: DataFrame) -> DataFrame:
    """Numbers that do not parse become null; more than one version is an error when the frame is checked."""
    have = set(raw.columns)
    return raw.select(*[(F.col(c) if c in have else F.lit(None).cast("string"))
                        .try_cast("double" if c in LOT_NUMBERS else "string").alias(c) for c in LOT_COLUMNS])


def check_single_version(lots: DataFrame) -> None:
    versions = lots.where(F.col("version").isNotNull()).agg(F.count_distinct("version").alias("versions"))
    assert_empty(versions.where(F.col("versions") != 1), "expected one lot version")


def latest_snapshot(df: DataFrame, version: str = "version") -> DataFrame:
    """Rows of the newest version; on a store partitioned by version this prunes to one folder."""
    newest = df.agg(F.max(version).alias("v"))
    return df.where(F.col(version) == newest.scalar())


def read_store(spark: SparkSession, path: str, columns: list[str] | None = None,
               months: list[str] | None = None) -> DataFrame:
    """A store of months: the current version of each where it has a manifest, else its month folders.

    The month list prunes folders, the column list prunes the read.
    """
    versions = current(spark, path)
    if versions:
        df = read_versions(spark, path, versions, months)
        return df.select(*columns) if columns else df
    df = spark.read.option("basePath", path).parquet(path)
    df = df.withColumn("month", F.col("month").cast("string")) if "month" in df.columns else df
    if months is not None:
        df = df.where(F.col("month").isin(months))
    return df.select(*columns) if columns else df


def with_month(df: DataFrame, ts: str = "created_date") -> DataFrame:
    return df.withColumn("month", month_label(ts))
