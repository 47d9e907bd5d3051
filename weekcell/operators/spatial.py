"""Points, straight pieces, hexagons: binning, distance-within join, snapping, clipping.

Segments are frames with one row per straight piece (``segment_id, x0, y0, x1,
y1`` in metres). A multi-part line is several pieces with one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcell.functions import geo
from weekcell.functions.predicates import active_at
from weekcell.operators.scale import assert_empty, salted_join, spread_rows
from weekcell.session import cut_lineage

TOLERANCE_M = 40.0
BUCKET_M = 100.0
SALTS = 8  # parts of a crowded bucket; the piece side is copied that often
SPACING = 0.5  # of a cell's edge, between the points of a piece that name candidate cells; must stay under 1.7
# fixed values: drop reasons in report order
DROP_REASONS = ["no_coords", "no_lane_within_tol", "lane_not_installed", "lane_not_active"]


def with_metric(df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y") -> DataFrame:
    mx, my = geo.to_metric(lon, lat)
    return df.withColumn(x, mx).withColumn(y, my)


def with_cell(df: DataFrame, x: str = "x", y: str = "y", name: str = "cell", edge: float = geo.HEX_EDGE_M) -> DataFrame:
    return df.withColumn(name, geo.point_cell(x, y, edge))


def lines_to_pieces(lines: DataFrame, points: str = "points") -> DataFrame:
    """Lines with ``points ARRAY<ARRAY<STRUCT<x, y>>>`` (parts of vertices) -> one row per straight piece."""
    part = lines.select("*", F.explode(points).alias("_part")).drop(points)
    ends = F.transform(F.sequence(F.lit(1), F.size("_part") - 1), lambda i: F.struct(
        F.element_at("_part", i).alias("a"), F.element_at("_part", i + 1).alias("b")))
    piece = part.where(F.size("_part") >= 2).withColumn("_e", F.explode(ends)).drop("_part")
    return piece.select("*", F.col("_e.a.x").alias("x0"), F.col("_e.a.y").alias("y0"),
                        F.col("_e.b.x").alias("x1"), F.col("_e.b.y").alias("y1")).drop("_e")


def piece_length(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return F.hypot(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))


def split_pieces(pieces: DataFrame, longest: float) -> DataFrame:
    """Cut pieces so that none is longer than ``longest``; keeps each bounding box small."""
    n = F.greatest(F.lit(1), F.ceil(piece_length() / longest)).cast("int")
    cut = pieces.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    return (cut.withColumn("_ax", at("x0", "x1", F.col("_k") - 1)).withColumn("_ay", at("y0", "y1", F.col("_k") - 1))
            .withColumn("_bx", at("x0", "x1", F.col("_k"))).withColumn("_by", at("y0", "y1", F.col("_k")))
            .drop("x0", "y0", "x1", "y1", "_n", "_k")
            .withColumnsRenamed({"_ax": "x0", "_ay": "y0", "_bx": "x1", "_by": "y1"}))


# -- line to cells -----------------------------------------------------------


def piece_cells(pieces: DataFrame, keys: list[str], edge: float = geo.HEX_EDGE_M) -> DataFrame:
    """(keys, cell, len_m): every cell a piece touches and the metres inside it; equal pieces of a key count once.

    Candidates are the cells of points along the piece and their rings, as one array of each piece, so that nothing is exchanged for
    them. A cell outside the ring of a point's cell is an edge length away from it at least; points half an edge apart
    therefore miss no cell. The exact clip keeps those that really meet the piece (touching counts).
    """
    base = spread_rows(pieces.select(*keys, "x0", "y0", "x1", "y1"), "x0", "y0", "x1", "y1").distinct()
    n = F.greatest(F.lit(1), F.ceil(piece_length() / (SPACING * edge))).cast("int")

    def seed(k: Column) -> Column:
        return geo.point_cell(F.col("x0") + (F.col("x1") - F.col("x0")) * k / n, F.col("y0") + (F.col("y1") - F.col("y0")) * k / n, edge)
    seeds = base.withColumn("_seeds", F.array_distinct(F.transform(F.sequence(F.lit(0), n), seed)))
    rings = F.array_distinct(F.flatten(F.transform("_seeds", lambda cell: geo.ring_cells(cell, True))))
    cand = seeds.select(*base.columns, F.explode(rings).alias("cell"))
    cx, cy = geo.cell_centre("cell", edge)
    placed = cand.withColumn("_cx", cx).withColumn("_cy", cy)
    t0, t1 = geo.clip_span(*[F.col(c) for c in ("_cx", "_cy", "x0", "y0", "x1", "y1")], edge)
    spans = placed.withColumn("_t0", t0).withColumn("_t1", t1).where(F.col("_t0") <= F.col("_t1"))
    return spans.select(*keys, "cell", ((F.col("_t1") - F.col("_t0")) * piece_length()).alias("len_m"))


def segment_cells(pieces: DataFrame, edge: float = geo.HEX_EDGE_M) -> DataFrame:
    """Bridge (segment_id, cell) with the metres of the segment in the cell."""
    return piece_cells(pieces, ["segment_id"], edge).groupBy("segment_id", "cell").agg(F.sum("len_m").alias("len_m"))


# -- distance within -----------------------------------------------------------


def _bucket(c: Column, bucket: float) -> Column:
    return F.floor(c / bucket)


def _bucketed(pieces: DataFrame, reach: float, bucket: float) -> DataFrame:
    """Pieces copied to each bucket that one of their parts, widened by ``reach``, meets; a piece is in a bucket once."""
    whole = pieces.select("*", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    parts = split_pieces(spread_rows(whole, "x0", "y0", "x1", "y1"), bucket)
    lo = lambda a, b: _bucket(F.least(F.col(a), F.col(b)) - reach, bucket)
    hi = lambda a, b: _bucket(F.greatest(F.col(a), F.col(b)) + reach, bucket)
    copies = (parts.withColumn("_bx", F.explode(F.sequence(lo("x0", "x1"), hi("x0", "x1"))))
              .withColumn("_by", F.explode(F.sequence(lo("y0", "y1"), hi("y0", "y1"))))
              .drop("x0", "y0", "x1", "y1").withColumnsRenamed({f"_{c}": c for c in ("x0", "y0", "x1", "y1")}))
    return copies.repartition("_bx", "_by").distinct()


def near_positions(points: DataFrame, pieces: DataFrame, tolerance: float = TOLERANCE_M, bucket: float = BUCKET_M,
                   salts: int = 1) -> DataFrame:
    """Distinct positions (x, y) of the points x piece columns for every pair at most ``tolerance`` apart, with ``dist_m``, fraction ``t``
    and the nearest point (near_x, near_y).

    A position that many points share is compared once. It is in one bucket, a piece in each bucket that its parts of
    bucket length come near, so no pair comes twice. Distances are taken from the whole piece. ``salts`` spreads the
    positions of a crowded bucket.

    The planner takes the copies of the pieces for as small as the lines are and would broadcast them through the
    driver; the hint keeps them in an exchange.
    """
    binned = (points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
              .withColumn("_bx", _bucket(F.col("x"), bucket)).withColumn("_by", _bucket(F.col("y"), bucket)))
    # a hair wider than asked, so that the distance alone decides at the bound
    pairs = salted_join(binned, _bucketed(pieces, tolerance + 0.01, bucket).hint("merge"), ["_bx", "_by"], "inner",
                        ["x", "y"], salts)
    t = geo.nearest_fraction(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])
    dx, dy = F.col("x") - F.col("near_x"), F.col("y") - F.col("near_y")
    return (pairs.drop("_bx", "_by").withColumn("t", t)
            .withColumn("near_x", F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0")))
            .withColumn("near_y", F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0")))
            .withColumn("dist_m", F.sqrt(dx * dx + dy * dy)).where(F.col("dist_m") <= tolerance))


def within_distance(points: DataFrame, pieces: DataFrame, tolerance: float = TOLERANCE_M, bucket: float = BUCKET_M,
                    salts: int = 1, spread: list[str] | None = None) -> DataFrame:
    """Point columns x columns of ``near_positions`` for every pair at most ``tolerance`` apart.

    ``salts`` spreads the points of a crowded position or bucket (needs ``spread``, the point key).
    """
    return salted_join(points, near_positions(points, pieces, tolerance, bucket, salts), ["x", "y"], "inner", spread or [], salts)


def snap(points: DataFrame, pieces: DataFrame, tolerance: float = TOLERANCE_M, edge: float = geo.HEX_EDGE_M,
         salts: int = SALTS) -> DataFrame:
    """Each point to its nearest segment valid at the point's time, or a reason why not.

    ``points``: point_id, ts, x, y (nullable). ``pieces``: in-scope pieces with
    segment_id, valid_from, valid_to, usable. Result: point_id, ts, raw_cell,
    segment_id, snap_dist_m, cell, drop_reason, one row per point.

    Candidates are numbered by distance once for each position, so that a point only looks for its lowest valid number.
    Distances equal to the nanometre are ties, which the lower id wins.
    """
    points = points.select("point_id", "ts", "x", "y")
    order = Window.partitionBy("x", "y").orderBy(F.round("dist_m", 9), "segment_id", "dist_m", "near_x", "near_y")
    near = cut_lineage(near_positions(points, pieces.select(
        "segment_id", "valid_from", "valid_to", "usable", "x0", "y0", "x1", "y1"), tolerance, salts=salts)
        .withColumn("_n", F.row_number().over(order))
        .select("x", "y", "_n", "segment_id", "valid_from", "valid_to", "usable", "dist_m", "near_x", "near_y"))
    valid = active_at(F.col("ts"))
    future = F.coalesce(F.col("usable") & (F.col("valid_from") > F.col("ts")), F.lit(False))
    # One pass per point: the nearest valid candidate and whether all candidates lie in the future.
    asked = salted_join(points, near.select("x", "y", "_n", "valid_from", "valid_to", "usable"), ["x", "y"], "inner", ["point_id"], salts)
    summary = asked.groupBy("point_id").agg(F.min(F.when(valid, F.col("_n"))).alias("_n"), F.bool_and(future).alias("_future"))
    joined = with_cell(points, "x", "y", "raw_cell", edge).join(summary, "point_id", "left")
    found = near.select("x", "y", "_n", "segment_id", "dist_m", F.col("near_x").alias("_nx"), F.col("near_y").alias("_ny"))
    placed = with_cell(joined.join(found, ["x", "y", "_n"], "left"), "_nx", "_ny", "cell", edge)
    reason = (F.when(F.col("x").isNull() | F.col("y").isNull(), DROP_REASONS[0])
              .when(F.col("_n").isNotNull(), F.lit(None))
              .when(F.col("_future").isNull(), DROP_REASONS[1])
              .when(F.col("_future"), DROP_REASONS[2]).otherwise(DROP_REASONS[3]))
    return placed.select("point_id", "ts", "raw_cell", "segment_id", F.col("dist_m").alias("snap_dist_m"), "cell",
                         reason.alias("drop_reason"))


def drop_stats(snapped: DataFrame) -> DataFrame:
    reason = F.col("drop_reason")
    moved = F.col("cell").isNotNull() & (F.col("cell") != F.col("raw_cell"))
    return snapped.agg(
        F.count("*").alias("points"), F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason.isNotNull()).alias("dropped"),
        F.round(F.try_divide(F.count_if(reason.isNotNull()).cast("double"), F.count("*").cast("double")), 4)
        .alias("dropped_fraction"),
        *[F.count_if(reason == r).alias(f"drop_{r}") for r in DROP_REASONS],
        F.count_if(moved).alias("kept_moved_cell"))


def cells_off_segment(snapped: DataFrame, bridge: DataFrame) -> DataFrame:
    """Kept points whose (segment, cell) is not in the bridge; expected empty."""
    return snapped.where(F.col("cell").isNotNull()).join(bridge.hint("merge"), ["segment_id", "cell"], "left_anti")


def check_cells_on_segments(snapped: DataFrame, bridge: DataFrame) -> None:
    assert_empty(cells_off_segment(snapped, bridge), "a kept point was assigned a cell its segment does not touch")


def grid_counts_to_cells(grid: DataFrame, lat: str = "grid_lat", lon: str = "grid_lon") -> DataFrame:
    """Located grid counts (month, lat, lon, n) -> (cell, month, n)."""
    located = grid.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return with_cell(with_metric(located, lon, lat)).groupBy("cell", "month").agg(F.sum("n").alias("n"))


def cells_without_network(lots: DataFrame, network: DataFrame) -> DataFrame:
    """Distinct cells of located lots that are not network cells."""
    return lots.where(F.col("cell").isNotNull()).select("cell").distinct().join(
        network.select("cell").distinct(), "cell", "left_anti")
