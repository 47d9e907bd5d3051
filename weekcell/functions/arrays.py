"""Expressions over sorted arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside the lambdas that ``body`` makes."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def places_after(values: Column, table: Column) -> Column:
    """For each of ``values`` the place in sorted ``table`` of the first entry that is greater (its size, if none is).

    Both are sorted together, so the cost is n log n however many values there are.
    """
    marked = F.concat(F.transform(table, lambda t, i: F.struct(t.alias("v"), F.lit(0).alias("of"), i.alias("i"))),
                      F.transform(values, lambda x, i: F.struct(x.alias("v"), F.lit(1).alias("of"), i.alias("i"))))
    ranked = F.transform(F.sort_array(marked), lambda e, at: F.struct(e["of"].alias("of"), e["i"].alias("i"), at.alias("at")))
    asked = F.filter(ranked, lambda e: e["of"] == 1)
    # a value's place in the common order, less the values before it, is the number of table entries up to it
    found = F.transform(asked, lambda e, rank: F.struct(e["i"].alias("i"), (e["at"] - rank).alias("place")))
    return F.transform(F.sort_array(found), lambda e: e["place"])
