"""Sessionising events per cell: anchored windows and chained gaps.

An anchored window opens at its first event and covers everything up to
``window`` later, inclusive; the next event opens another one. The windows of a
cell depend on each other through time, so a cell must not be one task.

Time is cut into blocks as long as a window, so one window opens in a block at most. What a block does is a step function:
*covered until* on entry -> *covered until* on exit, kept as a sorted array of
(entry, exit): entering covered until c gives the exit of the first pair whose entry is
greater than c, and c itself where there is none. Composition is associative, so
a tree over time chains the blocks of a cell: going up, each node composes its children's functions; going down, each node
tells its children what they are entered with. Then each block opens its window by itself.

Every step is a groupBy or an equi-join whose key holds the cell and a stretch of time,
on expressions only; there is one road for sparse and for crowded cells.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcell.functions.arrays import let, places_after
from weekcell.functions.calendar import hour_of_week, month_label
from weekcell.session import cut_lineage

WINDOW = timedelta(minutes=15)
#: Children of a node of the tree.
_FAN = 4096
#: The tree spans this many years around 1970; its depth follows from the length of a block.
_YEARS = 400
_MICROS = 1_000_000
_UNCOVERED = -(1 << 63)
_STEPS = "array<struct<entry:bigint,exit:bigint>>"


def _interval(window: timedelta) -> Column:
    return F.make_dt_interval(secs=F.lit(window.total_seconds()).cast("decimal(18,6)"))


def _day(ts: str) -> Column:
    return F.unix_date(F.to_date(F.col(ts)))


def _block(ts: str) -> Column:
    return _day(ts) * 24 + F.hour(F.col(ts))


def hour_blocks(events: DataFrame, window: timedelta) -> DataFrame:
    """(cell, block, lo, hi, n, prev_hi, linked): one row per cell and hour that has events."""
    per_cell = Window.partitionBy("cell").orderBy("block")
    blocks = events.groupBy("cell", _block("ts").alias("block")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    prev_hi = F.lag("hi").over(per_cell)
    return (blocks.withColumn("prev_hi", prev_hi)
            .withColumn("linked", F.coalesce(F.col("lo") <= F.col("prev_hi") + _interval(window), F.lit(False))))


# -- anchored windows ---------------------------------------------------------------


def _wall_micros(ts: str) -> Column:
    """Microseconds of the wall clock since 1970, zone-free."""
    part = F.extract(F.lit("SECOND"), F.col(ts)) * _MICROS
    return (F.unix_date(F.to_date(F.col(ts))).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60) * _MICROS + part.cast("bigint")


def _wall_time(micros: str) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(micros).cast("decimal(20,0)") / F.lit(_MICROS).cast("decimal(7,0)"))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _thin(steps: Column, limit: Column) -> Column:
    """Steps that an entry below ``limit`` can meet, the last of each row of equal exits."""
    near = F.filter(steps, lambda p, i: (i == 0) | (F.get(steps, i - 1)["entry"] < limit))
    return let(near, lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["exit"] != p["exit"], F.lit(True))))


def _compose(first: Column, then: Column, limit: Column) -> Column:
    """Step function of ``first`` and ``then`` one after the other, thinned."""
    def joined(at: Column) -> Column:
        through = F.transform(first, lambda p, i: F.struct(
            p["entry"].alias("entry"), F.coalesce(F.get(then, F.get(at, i))["exit"], p["exit"]).alias("exit")))
        last = F.coalesce(F.get(first, F.size(first) - 1)["entry"], _long(_UNCOVERED))
        return F.concat(through, F.filter(then, lambda p: p["entry"] > last))
    both = let(places_after(F.transform(first, lambda p: p["exit"]), F.transform(then, lambda p: p["entry"])), joined)
    return let(both, lambda s: _thin(s, limit))


def _leave(steps: Column, covered: Column) -> Column:
    """What a step function makes of one entry."""
    return F.coalesce(F.get(F.filter(steps, lambda p: p["entry"] > covered), F.lit(0))["exit"], covered)


def _parents(nodes: DataFrame, fan: int | None) -> DataFrame:
    """(cell, node, low, children, steps) one level up; without ``fan`` a cell has one parent.

    ``low`` is the earliest time of the node. Children are at most ``fan`` structs (node, low, steps) in the order of time.
    """
    up = F.floor(F.col("node") / fan) if fan else F.lit(0).cast("bigint")
    rows = nodes.groupBy("cell", up.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "low", "steps"))).alias("children"))
    return rows.select("cell", F.col("parent").alias("node"), F.get("children", F.lit(0))["low"].alias("low"), "children")


def _with_steps(nodes: DataFrame, w: int) -> DataFrame:
    folded = F.aggregate("children", F.array().cast(_STEPS), lambda acc, c: _compose(acc, c["steps"], F.col("low") + w))
    return nodes.withColumn("steps", folded)


def _entries(nodes: DataFrame) -> DataFrame:
    """(cell, node, covered) of the children of ``nodes`` (cell, children, covered)."""
    start = F.struct(F.col("covered").alias("c"), F.array().cast("array<struct<node:bigint,covered:bigint>>").alias("told"))
    told = F.aggregate(
        "children", start,
        lambda s, c: F.struct(_leave(c["steps"], s["c"]).alias("c"),
                              F.array_append(s["told"], F.struct(c["node"].alias("node"), s["c"].alias("covered"))).alias("told")),
        lambda s: s["told"])
    return nodes.select("cell", F.inline(told))


def _openings(covered: Column, times: Column, w: int) -> Column:
    """(start, n_events) of the windows in a block of sorted (t, n): the one carried in and the one that opens, if they take events.

    The block is no longer than a window, so the one that opens takes all that is left.
    """
    taken = F.filter(times, lambda e: e["t"] <= covered)
    left = F.filter(times, lambda e: e["t"] > covered)
    total = lambda events: F.aggregate(events, _long(0), lambda a, e: a + e["n"])
    return F.array_compact(F.array(
        F.when(F.size(taken) > 0, F.struct((covered - w).alias("start"), total(taken).alias("n_events"))),
        F.when(F.size(left) > 0, F.struct(F.get(left, F.lit(0))["t"].alias("start"), total(left).alias("n_events")))))


def anchored_incidents(events: DataFrame, window: timedelta = WINDOW) -> DataFrame:
    """Events (cell, ts) -> incidents (cell, start, n_events). Events without a cell or a time belong to none."""
    w = window // timedelta(microseconds=1)
    if w < 1:
        raise ValueError("a window lasts a microsecond at least")
    known = events.where(F.col("ts").isNotNull() & F.col("cell").isNotNull())
    times = known.groupBy("cell", _wall_micros("ts").alias("t")).agg(F.count("*").alias("n"))  # equal times are folded before they are dealt
    block = F.call_function("div", F.col("t") - F.pmod("t", _long(w)), _long(w))
    # read at the bottom of the tree and at its top, so written once
    blocks = cut_lineage(times.groupBy("cell", block.alias("node")).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("times")))
    level = blocks.select("cell", "node", F.get("times", F.lit(0))["t"].alias("low"),
                          F.transform("times", lambda e: F.struct(e["t"].alias("entry"), (e["t"] + w).alias("exit"))).alias("steps"))
    levels, reach = [], _YEARS * 366 * 86_400 * _MICROS // w
    while reach > _FAN:
        nodes = _parents(level, _FAN)
        levels.append(nodes)
        level = _with_steps(nodes, w).select("cell", "node", "low", "steps")
        reach //= _FAN
    told = _entries(_parents(level, None).withColumn("covered", _long(_UNCOVERED)))
    for nodes in reversed(levels):
        told = _entries(nodes.join(told, ["cell", "node"]))
    opened = blocks.join(told, ["cell", "node"]).select("cell", F.inline(_openings(F.col("covered"), F.col("times"), w)))
    # a window that crosses the border of two blocks comes from both
    return (opened.groupBy("cell", "start").agg(F.sum("n_events").alias("n_events"))
            .select("cell", _wall_time("start").alias("start"), "n_events"))


# -- rows, chained sessions, incident table ----------------------------------


def assign_incidents(events: DataFrame, window: timedelta = WINDOW) -> DataFrame:
    """Every event with the start of the incident it belongs to (column ``incident_start``).

    Windows of a cell never overlap, so an event has one match; both sides are
    joined on (cell, slice of one window length), which also splits a hot cell.
    """
    seconds = int(window.total_seconds())
    slice_of = lambda ts: F.floor((_day_seconds(ts)) / seconds)
    starts = anchored_incidents(events, window).select(F.col("cell"), F.col("start").alias("incident_start"))
    slices = starts.withColumn("_slice", F.explode(F.array(
        slice_of(F.col("incident_start")), slice_of(F.col("incident_start")) + 1)))
    rows = events.withColumn("_slice", slice_of(F.col("ts")))
    hit = (F.col("ts") >= F.col("incident_start")) & (F.col("ts") <= F.col("incident_start") + _interval(window))
    return rows.join(slices, ["cell", "_slice"]).where(hit).drop("_slice")


def _day_seconds(ts: Column) -> Column:
    """Whole seconds of the wall clock since 1970, zone-free."""
    return (F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.second(ts))


def chained_sessions(events: DataFrame, gap: timedelta = WINDOW) -> DataFrame:
    """Events with the start of their session, where a gap longer than ``gap`` to the previous event opens one.

    The running state crosses hour blocks through a table with one row per
    (cell, hour); the event rows are only windowed within their hour.
    """
    blocks = hour_blocks(events, gap).select("cell", "block", "prev_hi")
    in_block = Window.partitionBy("cell", "block").orderBy("ts")
    rows = events.withColumn("block", _block("ts")).join(blocks, ["cell", "block"])
    prev = F.coalesce(F.lag("ts").over(in_block), F.col("prev_hi"))
    opens = prev.isNull() | (F.col("ts") > prev + _interval(gap))
    upto = in_block.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_open", F.when(opens, F.col("ts"))).withColumn("_here", F.max("_open").over(upto))
    per_cell = Window.partitionBy("cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (marked.groupBy("cell", "block").agg(F.max("_open").alias("_latest"))
               .select("cell", "block", F.last("_latest", ignorenulls=True).over(per_cell).alias("_carry")))
    return (marked.join(carried, ["cell", "block"])
            .withColumn("session_start", F.coalesce("_here", "_carry"))
            .drop("block", "prev_hi", "_open", "_here", "_carry"))


def incident_table(events: DataFrame, window: timedelta = WINDOW) -> DataFrame:
    """(cell, start, month, hour_of_week, n_events); the first event sets month and slot."""
    inc = anchored_incidents(events, window)
    return inc.select("cell", "start", month_label("start").alias("month"),
                      hour_of_week("start").cast("smallint").alias("hour_of_week"), "n_events")
