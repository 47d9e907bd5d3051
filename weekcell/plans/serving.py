"""Served tables: predictions per cell and hour of the week, cells, metadata, and lookups over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weekcell.functions import geo
from weekcell.functions.calendar import (DAY_NAMES, LOCAL_ZONE, SLOTS, day_of_week, hour_of_day, parse_slot)
from weekcell.functions.predicates import LANE_TYPES, code_label
from weekcell.operators.scale import assert_empty, exact_quantiles

LAYERS = ["predicted", "adjusted", "historical"]
# fixed values: colour-scale quantiles and the floor of the reporting index
SCALE_QUANTILES = [0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995]
FLOOR_QUANTILE = 0.05
UNITS = "expected reported incidents per occurrence of the hour (per week for one slot)"
CAVEAT = "Layers show reported events, not observed ones; the adjusted layer is a heuristic."


def slot_spine(cells: DataFrame) -> DataFrame:
    return cells.select("cell").distinct().withColumn("hour_of_week", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))


def reporting_index(raw: DataFrame, value: str = "value") -> DataFrame:
    """(cell, propensity_index): value over its median, floored at the 5th percentile; neither may be 0."""
    median = exact_quantiles(raw, value, [0.5], "q").select(F.col("q")[0].alias("m"))
    scaled = raw.select("cell", (F.col(value).cast("double") / F.when(median.scalar() > 0, median.scalar()).otherwise(
        F.raise_error(F.lit("median propensity is not positive")).cast("double"))).alias("_r"))
    floor = exact_quantiles(scaled, "_r", [FLOOR_QUANTILE], "q").select(F.col("q")[0].alias("f"))
    lowest = F.when(floor.scalar() > 0, floor.scalar()).otherwise(
        F.raise_error(F.lit("propensity floor is not positive")).cast("double"))
    return scaled.select("cell", F.greatest("_r", lowest).alias("propensity_index"))


def trailing_background(background: DataFrame, neighbours: DataFrame, cells: DataFrame, month: str, window: int = 12) -> DataFrame:
    """(cell, value): background events of the cell and its ring-1 neighbours over the ``window`` months before ``month``; 0 without any.

    Counts (cell, month, n) are cut to the window before anything is sent to a neighbour, so data of the served month or later has no part.
    """
    at = int(month[:4]) * 12 + int(month[5:]) - 1
    lo = f"{(at - window) // 12:04d}-{(at - window) % 12 + 1:02d}"
    own = background.where((F.col("month") >= lo) & (F.col("month") < month)).groupBy("cell").agg(F.sum("n").alias("n"))
    sent = own.join(neighbours, "cell").select(F.col("neighbour").alias("cell"), "n")
    sums = own.unionByName(sent).groupBy("cell").agg(F.sum("n").cast("double").alias("value"))
    return cells.select("cell").distinct().join(sums, "cell", "left").select("cell", F.coalesce("value", F.lit(0.0)).alias("value"))


def historical_rates(cells: DataFrame, panel: DataFrame, month: str) -> DataFrame:
    """(cell, hour_of_week, historical, historical_hours) over the 12 months before ``month``; no history is 0."""
    year, number = (int(x) for x in month.split("-"))
    # month labels sort as text, so two literals reach the scan
    used = panel.where((F.col("month") >= f"{year - 1:04d}-{number:02d}") & (F.col("month") < month))
    return historical_of(cells, used.groupBy("cell", F.col("hour_of_week").cast("int").alias("hour_of_week")).agg(
        F.sum("y").alias("y"), F.sum("exposure").alias("exposure")))


def historical_of(cells: DataFrame, sums: DataFrame) -> DataFrame:
    """The rates of ``historical_rates`` from (cell, hour_of_week, y, exposure) of the twelve months."""
    out = slot_spine(cells).join(sums, ["cell", "hour_of_week"], "left")
    return out.select("cell", "hour_of_week",
                      F.coalesce(F.try_divide(F.col("y").cast("double"), F.col("exposure").cast("double")), F.lit(0.0)).alias("historical"),
                      F.coalesce("exposure", F.lit(0)).cast("double").alias("historical_hours"))


def scale_edges(preds: DataFrame, column: str, name: str = "edges") -> DataFrame:
    """One row: quantiles of the positive values; all 0 when there is none."""
    edges = exact_quantiles(preds.where(F.col(column) > 0), column, SCALE_QUANTILES, name)
    zero = F.array(*[F.lit(0.0)] * len(SCALE_QUANTILES))
    return edges.select(F.when(F.col(name)[0].isNotNull(), F.col(name)).otherwise(zero).alias(name))


def serve_predictions(raw: DataFrame, factor: float | Column, index: DataFrame, history: DataFrame) -> DataFrame:
    """(cell, hour_of_week, mu) -> the three layers."""
    level = factor if isinstance(factor, Column) else F.lit(factor)
    return (raw.select("cell", F.col("hour_of_week").cast("int"), (F.col("mu") * level).alias("predicted"))
            .join(index, "cell", "left")
            .withColumn("adjusted", F.col("predicted") / F.col("propensity_index")).drop("propensity_index")
            .join(history, ["cell", "hour_of_week"], "left")
            .select("cell", "hour_of_week", *LAYERS, "historical_hours"))


def cell_table(preds: DataFrame, features: DataFrame, index: DataFrame, edge: float = geo.HEX_EDGE_M) -> DataFrame:
    """One row per cell: centre, borough, lane metres, index, weekly totals per layer."""
    weekly = preds.groupBy("cell").agg(*[F.sum(c).alias(f"{c}_weekly") for c in LAYERS])
    cx, cy = geo.cell_centre("cell", edge)
    lanes = [f"lane_m_{t}" for t in LANE_TYPES] + ["lane_m_total"]
    placed = weekly.withColumn("_x", cx).withColumn("_y", cy)
    lng, lat = geo.to_lonlat("_x", "_y")
    return (placed.withColumn("lat", lat).withColumn("lng", lng).drop("_x", "_y")
            .join(features.select("cell", code_label("boro").alias("borough"), *lanes), "cell", "left")
            .join(index, "cell", "left"))


def violations(preds: DataFrame, cells: DataFrame) -> DataFrame:
    """(problem, cell, detail) rows; an empty result means every cell has 168 good slots."""
    per = preds.groupBy("cell").agg(
        F.count("hour_of_week").alias("n"), F.count_distinct("hour_of_week").alias("d"),
        F.min("hour_of_week").alias("lo"), F.max("hour_of_week").alias("hi"),
        *[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"bad_{c}")
          for c in [*LAYERS, "historical_hours"]],
        *[F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in [*LAYERS, "historical_hours"]])
    wrong = (F.col("n") != SLOTS) | (F.col("d") != SLOTS) | (F.col("lo") != 0) | (F.col("hi") != SLOTS - 1)
    found = F.array_compact(F.array(
        F.when(wrong, F.lit("not 168 distinct slots")),
        *[F.when(F.col(f"bad_{c}") > 0, F.lit(f"NaN or infinite {c}")) for c in [*LAYERS, "historical_hours"]],
        *[F.when(F.col(f"neg_{c}") > 0, F.lit(f"negative {c}")) for c in [*LAYERS, "historical_hours"]]))
    known = cells.select("cell").distinct()
    return (per.select("cell", F.explode(found).alias("problem"))
            .unionByName(known.join(per, "cell", "left_anti").select("cell", F.lit("missing cell").alias("problem")))
            .unionByName(per.join(known, "cell", "left_anti").select("cell", F.lit("unexpected cell").alias("problem"))))


def latest_pull_date(control: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    newest = F.max("pulled_at").cast("timestamp_ntz")
    return control.agg(F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), newest)).alias("pull_date"))


def metadata(preds: DataFrame, cells: DataFrame, land: DataFrame, month: str, model: dict, level: DataFrame,
             trips_through: str) -> DataFrame:
    """One row describing the served tables."""
    pe, ae = scale_edges(preds, "predicted"), scale_edges(preds, "adjusted")
    n_cells = cells.agg(F.count("*").alias("n"))
    n_land = land.agg(F.count("*").alias("n"))
    return level.select(
        F.lit(month).alias("month"), F.current_timestamp().alias("generated_at"),
        F.struct(*[F.lit(v).alias(k) for k, v in model.items()]).alias("model"),
        F.struct(*[F.col(c) for c in level.columns]).alias("recalibration"),
        F.lit(trips_through).alias("trips_through"), n_cells.scalar().alias("cells"), F.lit(SLOTS).alias("slots"),
        F.lit(UNITS).alias("units"), F.lit(CAVEAT).alias("caveat"),
        F.struct(pe.scalar().alias("predicted"), ae.scalar().alias("adjusted"),
                 pe.scalar().alias("historical")).alias("scale"),
        n_land.scalar().alias("off_network_land_cells"))


@dataclass
class Artifact:
    predictions: DataFrame
    cells: DataFrame
    land: DataFrame
    meta: DataFrame


def write_artifact(art: Artifact, folder: str) -> None:
    """Nothing is written unless the tables are valid; the metadata goes last."""
    assert_empty(violations(art.predictions, art.cells), "served table is incomplete")
    (art.predictions.withColumn("hour_of_week", F.col("hour_of_week").cast("smallint"))
     .repartitionByRange("hour_of_week", "cell").sortWithinPartitions("hour_of_week", "cell")
     .write.mode("overwrite").parquet(f"{folder}/predictions"))
    art.cells.write.mode("overwrite").parquet(f"{folder}/cells")
    art.land.write.mode("overwrite").parquet(f"{folder}/land_cells")
    art.meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


# -- lookups -----------------------------------------------------------------------------


def resolve_slot(spark, how: int | None = None, day: str | None = None, hour: int | None = None) -> int:
    """Slot number from either a slot or a day and an hour; anything else is an error."""
    if how is not None and (day is not None or hour is not None):
        raise ValueError("give either how, or day and hour")
    if how is None and (day is None or hour is None):
        raise ValueError("give how, or day and hour")
    if how is None:
        how = spark.range(1).select(parse_slot(F.lit(day), F.lit(hour)).alias("s")).first()["s"]
        if how is None:
            raise ValueError(f"day must be one of {DAY_NAMES} and hour 0..23")
    if not 0 <= how < SLOTS:
        raise ValueError("how must be 0..167")
    return how


def slot_query(preds: DataFrame, how: int, layer: str = "predicted") -> DataFrame:
    """All cells of one slot and layer, with the layer's maximum over the slot."""
    if layer not in LAYERS:
        raise ValueError(f"layer must be one of {LAYERS}")
    one = preds.where(F.col("hour_of_week") == how)
    top = one.agg(F.max(layer).alias("m"))
    return one.select("cell", F.lit(how).alias("hour_of_week"), F.element_at(
        F.array(*[F.lit(d) for d in DAY_NAMES]), day_of_week(F.lit(how)) + 1).alias("day"),
        hour_of_day(F.lit(how)).alias("hour"), F.lit(layer).alias("layer"), F.col(layer).alias("value"),
        top.scalar().alias("max_value"))


def cell_series(preds: DataFrame) -> DataFrame:
    """One row per cell: a 168-value array per layer plus the hours behind the history, and weekly totals."""
    row = F.struct(F.col("hour_of_week").cast("int").alias("h"), *[F.round(c, 6).alias(c) for c in LAYERS],
                   F.col("historical_hours"))
    packed = preds.groupBy("cell").agg(F.array_sort(F.collect_list(row)).alias("_s"),
                                       *[F.sum(c).alias(f"{c}_weekly") for c in LAYERS])
    # A field of an array of structs is the array of that field.
    return packed.select("cell", *[F.col(f"_s.{c}").alias(f"{c}_series") for c in LAYERS],
                         F.col("_s.historical_hours").alias("historical_hours"), *[f"{c}_weekly" for c in LAYERS])


def cell_detail(cells: DataFrame, preds: DataFrame, cell: str | None = None) -> DataFrame:
    """Cell attributes, lane metres and shares, series; a share of nothing is 0."""
    pick = (lambda df: df) if cell is None else (lambda df: df.where(F.col("cell") == cell))
    total = F.col("lane_m_total")
    shares = [F.when(total > 0, F.round(F.col(f"lane_m_{t}") / total, 3)).otherwise(0.0).alias(f"lane_share_{t}")
              for t in LANE_TYPES]
    metres = [F.round(f"lane_m_{t}", 1).alias(f"lane_m_{t}") for t in LANE_TYPES]
    base = pick(cells).select("cell", "lat", "lng", "borough", *metres, *shares, "propensity_index")
    return base.join(cell_series(pick(preds)), "cell")


def grid_listing(cells: DataFrame, land: DataFrame) -> DataFrame:
    return (cells.select("cell", F.lit("network").alias("kind"))
            .unionByName(land.select("cell", F.lit("off_network").alias("kind"))))
