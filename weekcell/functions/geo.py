"""Planar geometry as Column expressions.

Coordinates are projected to metres (transverse Mercator, UTM zone 18N), then
binned into pointy-top hexagons in axial coordinates. A cell id is the string
'q:r', so neighbours, corners and centres are arithmetic and need no lookup;
callers that bring their own cell ids pass a neighbour table instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# fixed values: WGS84 ellipsoid and UTM 18N
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_CENTRAL_MERIDIAN = -75.0
UTM_FALSE_EASTING = 500000.0
# hexagon edge that gives about 0.104 square kilometres per cell
HEX_EDGE_M = 200.0
SQRT3 = math.sqrt(3.0)
# axial steps to the six neighbours
RING1 = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]

_N = WGS84_F / (2 - WGS84_F)
_RECT_A = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_metric(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """(easting, northing) in metres by the third-order series."""
    phi = F.radians(_col(lat))
    lam = F.radians(_col(lon) - UTM_CENTRAL_MERIDIAN)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_FALSE_EASTING + UTM_K0 * _RECT_A * x, UTM_K0 * _RECT_A * y


def to_lonlat(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Inverse of ``to_metric``: (lon, lat) in degrees."""
    xi = _col(y) / (UTM_K0 * _RECT_A)
    eta = (_col(x) - UTM_FALSE_EASTING) / (UTM_K0 * _RECT_A)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return UTM_CENTRAL_MERIDIAN + F.degrees(lam), F.degrees(phi)


def snap_grid(value: Column | str, step: float = 0.002, places: int = 3) -> Column:
    """Nearest multiple of ``step``: the centre of a coordinate grid cell."""
    return F.round(F.round(_col(value) / step) * step, places)


def round_coord(value: Column | str, places: int = 5) -> Column:
    """Half-even rounding of a coordinate; text that is no number becomes null."""
    return F.bround(_col(value).try_cast("double"), places)


def axial(x: Column | str, y: Column | str, edge: float = HEX_EDGE_M) -> tuple[Column, Column]:
    """Axial (q, r) of the hexagon holding a metric point."""
    x, y = _col(x), _col(y)
    fq = (SQRT3 / 3 * x - y / 3) / edge
    fr = (2.0 / 3 * y) / edge
    fs = -fq - fr
    q, r, s = F.floor(fq + 0.5), F.floor(fr + 0.5), F.floor(fs + 0.5)
    dq, dr, ds = F.abs(q - fq), F.abs(r - fr), F.abs(s - fs)
    qq = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    rr = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    return qq.cast("bigint"), rr.cast("bigint")


def cell_id(q: Column | str, r: Column | str) -> Column:
    return F.concat_ws(":", _col(q).cast("string"), _col(r).cast("string"))


def point_cell(x: Column | str, y: Column | str, edge: float = HEX_EDGE_M) -> Column:
    """Cell of a metric point; null when a coordinate is null."""
    q, r = axial(x, y, edge)
    return F.when(_col(x).isNotNull() & _col(y).isNotNull(), cell_id(q, r))


def cell_axes(cell: Column | str) -> tuple[Column, Column]:
    parts = F.split(_col(cell), ":")
    return parts[0].cast("bigint"), parts[1].cast("bigint")


def ring_cells(cell: Column | str, include_self: bool) -> Column:
    """Array of the ring-1 cells, with or without the cell itself."""
    q, r = cell_axes(cell)
    steps = ([(0, 0)] if include_self else []) + RING1
    return F.array(*[cell_id(q + dq, r + dr) for dq, dr in steps])


def cell_centre(cell: Column | str, edge: float = HEX_EDGE_M) -> tuple[Column, Column]:
    q, r = cell_axes(cell)
    return edge * (SQRT3 * q + SQRT3 / 2 * r), edge * 1.5 * r


def cell_corners(cell: Column | str, edge: float = HEX_EDGE_M) -> Column:
    """Array of six corner structs, counter-clockwise from the lower right."""
    cx, cy = cell_centre(cell, edge)
    corners = []
    for k in range(6):
        a = math.radians(60 * k - 30)
        corners.append(F.struct((cx + edge * math.cos(a)).alias("x"), (cy + edge * math.sin(a)).alias("y")))
    return F.array(*corners)


def nearest_fraction(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Clamped position (0..1) of the point of a straight piece closest to (px, py)."""
    dx, dy = x1 - x0, y1 - y0
    length2 = dx * dx + dy * dy
    t = ((px - x0) * dx + (py - y0) * dy) / length2
    return F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(F.lit(0.0))


def clip_span(cx: Column, cy: Column, x0: Column, y0: Column, x1: Column, y1: Column,
              edge: float = HEX_EDGE_M) -> tuple[Column, Column]:
    """(t0, t1) of the part of a straight piece inside the hexagon around (cx, cy); t0 > t1 when it misses.

    The hexagon is the meet of three strips around its centre, so the piece is
    cut by three pairs of parallel lines.
    """
    apothem = edge * SQRT3 / 2
    t0, t1 = F.lit(0.0), F.lit(1.0)
    for k in range(3):
        a = math.radians(60 * k)
        nx, ny = math.cos(a), math.sin(a)
        start = (x0 - cx) * nx + (y0 - cy) * ny
        step = (x1 - x0) * nx + (y1 - y0) * ny
        # A piece parallel to the strip is inside for all t or for none.
        parallel = F.abs(step) < 1e-12
        inside = F.abs(start) <= apothem
        ta = (-apothem - start) / F.when(parallel, F.lit(1.0)).otherwise(step)
        tb = (apothem - start) / F.when(parallel, F.lit(1.0)).otherwise(step)
        lo = F.when(parallel, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(ta, tb))
        hi = F.when(parallel, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(ta, tb))
        t0, t1 = F.greatest(t0, lo), F.least(t1, hi)
    return t0, t1
