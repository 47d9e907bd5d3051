"""Row predicates and small classifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from weekcell.functions.calendar import month_start

# fixed values: inclusive latitude and longitude box of the city
BBOX = {"lat": (40.47, 40.93), "lon": (-74.27, -73.68)}
# fixed values: network scope
SCOPE_CLASSES = ["I", "II"]
SCOPE_STREET = "ON"
# fixed values: lane types in feature order
LANE_TYPES = ["protected", "curbside", "buffered", "conventional"]
# fixed values: land-use codes counted as commercial
COMMERCIAL_LANDUSE = ["4", "5"]
# fixed values: borough names by code
BOROUGH_NAMES = {"1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*clauses: Column) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def is_target(kind: Column | str, detail: Column | str, pair: tuple[str, str]) -> Column:
    return (_col(kind) == pair[0]) & (_col(detail) == pair[1])


def is_not_target(kind: Column | str, detail: Column | str, pair: tuple[str, str]) -> Column:
    """Complement that keeps rows whose kind or detail is null."""
    return ~(_col(kind).eqNullSafe(pair[0]) & _col(detail).eqNullSafe(pair[1]))


def in_dates(ts: Column | str, start=None, end=None) -> Column:
    """Half-open range; a missing bound is open."""
    clauses = []
    if start is not None:
        clauses.append(_col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        clauses.append(_col(ts) < F.lit(end).cast("timestamp_ntz"))
    return all_of(*clauses)


def in_bbox(lat: Column | str, lon: Column | str, box: dict[str, tuple[float, float]] = BBOX) -> Column:
    return F.coalesce(_col(lat).between(*box["lat"]) & _col(lon).between(*box["lon"]), F.lit(False))


def in_scope(scope: str, lane_class: Column | str = "lane_class", street: Column | str = "on_street") -> Column:
    if scope == "all":
        return F.lit(True)
    if scope == "lanes_on_street":
        return _col(lane_class).isin(SCOPE_CLASSES) & (_col(street) == SCOPE_STREET)
    raise ValueError(f"unknown scope {scope!r}; expected 'all' or 'lanes_on_street'")


def active_at(when: Column, start: Column | str = "valid_from", end: Column | str = "valid_to",
              usable: Column | str = "usable") -> Column:
    """Half-open validity at an instant; unusable or undated rows are never active."""
    inside = (_col(start) <= when) & (_col(end).isNull() | (when < _col(end)))
    return F.coalesce(_col(usable) & inside, F.lit(False))


def active_in_month(month_idx: Column, start: Column | str = "valid_from", end: Column | str = "valid_to",
                    usable: Column | str = "usable") -> Column:
    """Valid during the whole month."""
    inside = (_col(start) <= month_start(month_idx)) & (_col(end).isNull() | (_col(end) >= month_start(month_idx + 1)))
    return F.coalesce(_col(usable) & inside, F.lit(False))


def exclude_reason(status: Column | str = "status", start: Column | str = "valid_from",
                   end: Column | str = "valid_to") -> Column:
    """Why the dates of a line cannot be used; the missing start outranks the others."""
    return (F.when(_col(start).isNull(), "no_instdate")
            .when(_col(end) < _col(start), "ret_before_inst")
            .when((_col(status) == "Retired") & _col(end).isNull(), "retired_no_ret_date"))


def lane_type(lane_class: Column | str = "lane_class", ft: Column | str = "ft_facility",
              tf: Column | str = "tf_facility") -> Column:
    detail = F.coalesce(_col(ft), _col(tf), F.lit(""))
    return (F.when(_col(lane_class) == "I", "protected")
            .when(detail.startswith("Curbside"), "curbside")
            .when(detail.startswith("Conventional Buffered"), "buffered")
            .otherwise("conventional"))


def contains_either(a: Column | str, b: Column | str, pattern: str) -> Column:
    """Case-insensitive substring test on either of two nullable columns."""
    p = pattern.upper()
    return F.upper(F.coalesce(_col(a), F.lit(""))).contains(p) | F.upper(F.coalesce(_col(b), F.lit(""))).contains(p)


def mentions_all(a: Column | str, b: Column | str, words: list[str]) -> Column:
    """Every word occurs in the two columns read together."""
    text = F.upper(F.concat_ws(" ", F.coalesce(_col(a), F.lit("")), F.coalesce(_col(b), F.lit(""))))
    return all_of(*[text.contains(w.upper()) for w in words])


def code_label(code: Column | str, labels: dict[str, str] = BOROUGH_NAMES) -> Column:
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(code).cast("string"))


def colour_bin(value: Column | str, edges: list[float] | Column) -> Column:
    """Number of leading edges the value reaches (0 .. number of edges)."""
    arr = edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(arr, lambda e: _col(value) >= e))


def safe_ratio(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    r = F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
    return r if default is None else F.coalesce(r, F.lit(default))


def drop_prefixed(columns: list[str], prefixes: tuple[str, ...]) -> list[str]:
    """Column names left after an ablation by name prefix."""
    return [c for c in columns if not (prefixes and c.startswith(tuple(prefixes)))]
