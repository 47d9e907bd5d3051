"""Leak-safe trailing windows over a month axis.

Every window is ``[M - w, M - 1]`` in month numbers (RANGE, never ROWS), taken
on the union of the months that have data and the months that are asked for.
Inputs are folded to one row per key and month before the window, so a key's
window is never longer than the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcell.functions.geo import ring_cells


def trailing_sum(value: Column, keys: list[str], window: int, month: str = "month_idx") -> Column:
    """Sum of counts over the ``window`` months before, as a difference of two running sums.

    Running frames are updated row by row, while a sliding frame is added up
    again for every row; counts keep the difference exact.
    """
    def upto(last: int) -> Column:
        frame = Window.partitionBy(*keys).orderBy(month).rangeBetween(Window.unboundedPreceding, -last)
        return F.coalesce(F.sum(value).over(frame), F.lit(0))

    return upto(1) - upto(window + 1)


def trailing_features(spine: DataFrame, parts: list[tuple[DataFrame, str | list[str]]], keys: list[str],
                      features: dict[str, tuple[str, int]], month: str = "month_idx", partitions: int | None = None) -> DataFrame:
    """Spine rows (keys, month) with one trailing sum per feature.

    ``parts`` are (frame with keys, month and value columns, value column or columns)
    pairs; they are stacked and folded together, so all features cost one shuffle.
    ``features`` maps output name -> (value column, window in months). Dense spines bring their number of ``partitions``: adaptive
    execution merges tasks by the bytes of an exchange, and rows of running keys and zeros take far more when they are sorted.
    """
    listed = [(df, [v] if isinstance(v, str) else list(v)) for df, v in parts]
    names = [n for _, vs in listed for n in vs]
    zero = F.lit(0).cast("double")
    stacked = spine.select(*keys, month, *[zero.alias(v) for v in names], F.lit(1).alias("_asked"))
    for frame, values in listed:
        stacked = stacked.unionByName(frame.select(
            *keys, month, *[(F.col(v).cast("double") if v in values else zero).alias(v) for v in names],
            F.lit(0).alias("_asked")))
    # Partitioned by the window key up front, the fold and the windows share one shuffle.
    folded = stacked.repartition(*([partitions] if partitions else []), *keys).groupBy(*keys, month).agg(*[F.sum(v).alias(v) for v in names], F.max("_asked").alias("_asked"))
    out = folded.select(*keys, month, "_asked",
                        *[trailing_sum(F.col(v), keys, w, month).alias(name) for name, (v, w) in features.items()])
    return out.where(F.col("_asked") == 1).drop("_asked")


def ring_sum(counts: DataFrame, value: str, include_self: bool, neighbours: DataFrame | None = None,
             month: str = "month_idx") -> DataFrame:
    """Sum over ring-1 neighbours, per cell and month, from sparse counts.

    Each count is sent to the cells that see it. Axial ids need no lookup; other
    ids bring ``neighbours(cell, neighbour)``, which must hold both directions.
    """
    group = ["cell", month] if month in counts.columns else ["cell"]
    if neighbours is None:
        sent = counts.withColumn("cell", F.explode(ring_cells("cell", include_self)))
    else:
        sent = counts.join(neighbours, "cell").withColumn("cell", F.col("neighbour")).drop("neighbour")
        if include_self:
            sent = sent.unionByName(counts.select(*sent.columns))
    return sent.groupBy(*group).agg(F.sum(value).alias(value))


def trailing_ratio(monthly: DataFrame, window: int = 3, month: str = "month_idx") -> DataFrame:
    """factor = observed / predicted over the ``window`` previous rows; null until that many exist.

    ``monthly`` has one row per month, so the unpartitioned window is as long as the calendar.
    """
    frame = Window.orderBy(month).rowsBetween(-window, -1)
    ready = F.count("*").over(frame) == window
    ratio = F.try_divide(F.sum("observed").over(frame).cast("double"), F.sum("predicted").over(frame).cast("double"))
    return monthly.withColumn("factor", F.when(ready, ratio))


def month_changes(series: DataFrame, month: str = "month", value: str = "n") -> DataFrame:
    """Change and percent change against the previous row of a month series."""
    prev = F.lag(value).over(Window.orderBy(month))  # one row per month
    return (series.withColumn("prev", prev).where(F.col("prev").isNotNull())
            .withColumn("change", F.col(value) - F.col("prev"))
            .withColumn("pct", F.try_divide(F.col("change").cast("double"), F.col("prev").cast("double")) * 100))
