"""X2 and X3: the level factor at the border of the served month, and an index that no later data reaches."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from weekcell.plans import level, serving as sv


def predicted(spark, months, rate):
    """One cell with a constant hourly rate over whole months."""
    data = [("c", m, h, rate * 4, 4) for m in months for h in range(168)]
    return spark.createDataFrame(data, "cell string, month string, hour_of_week int, mu double, exposure int")


def test_X2_days_come_from_the_side_they_lie_on(spark):
    """Stored months predict 1 an hour, the served one 3; stored rows of the served month and served rows of others are ignored."""
    prior, serving = predicted(spark, ["2031-02", "2031-03", "2031-04"], 1.0), predicted(spark, ["2031-03", "2031-04", "2031-05"], 3.0)
    draw = random.Random(6)
    starts = [datetime(2031, 2, 1) + timedelta(hours=draw.randrange(24 * 110)) for _ in range(500)]
    events = spark.createDataFrame([("c", f"{t:%Y-%m}", t) for t in starts], "cell string, month string, start timestamp_ntz")
    for as_of in ("2031-03-31", "2031-04-02", "2031-04-03", "2031-04-17", "2031-05-02"):
        end = date.fromisoformat(as_of) - timedelta(days=2)
        days = [end - timedelta(days=k) for k in range(56)]
        want_predicted = sum(24 * (3.0 if d >= date(2031, 4, 1) else 1.0) for d in days)
        want_observed = sum(t.date() in set(days) for t in starts)
        r = level.serving_factor(prior, serving, events, "2031-04", as_of).first()
        assert (r.window_start, r.window_end, r.observed) == (days[-1], end, want_observed)
        assert r.predicted == pytest.approx(want_predicted) and r.factor == pytest.approx(want_observed / want_predicted)


def test_X2_past_the_month_and_uncovered(spark):
    prior, serving = predicted(spark, ["2031-03"], 1.0), predicted(spark, ["2031-04"], 1.0)
    none = spark.createDataFrame([], "cell string, month string, start timestamp_ntz")
    with pytest.raises(ValueError, match="after the served month"):
        level.serving_factor(prior, serving, none, "2031-04", "2031-05-03")
    with pytest.raises(Exception, match="not covered"):  # the window begins in February, of which nothing is stored
        level.serving_factor(prior, serving, none, "2031-04", "2031-04-10").collect()


def test_X3_trailing_background_own_and_ring(spark):
    months = [f"{y}-{m:02d}" for y in (2029, 2030, 2031) for m in range(1, 13)]
    counts = [(c, m, k * 7 % 5 + i + 1) for i, c in enumerate("pqrs") for k, m in enumerate(months)]
    near = [("p", "q"), ("q", "p"), ("q", "r"), ("r", "q"), ("r", "s"), ("s", "r")]
    df = spark.createDataFrame(counts, "cell string, month string, n int")
    ring = spark.createDataFrame(near, "cell string, neighbour string")
    cells = spark.createDataFrame([("p",), ("q",), ("r",), ("alone",)], "cell string")
    window = [m for m in months if "2030-03" <= m < "2031-03"]
    assert len(window) == 12
    reach = {"p": "pq", "q": "pqr", "r": "qrs", "alone": ""}
    want = sorted((c, float(sum(n for x, m, n in counts if x in seen and m in window))) for c, seen in reach.items())
    assert rows(sv.trailing_background(df, ring, cells, "2031-03")) == want
    # later counts, and earlier ones than the window, change nothing
    outside = df.withColumn("n", F.when(F.col("month").between("2030-03", "2031-02"), F.col("n")).otherwise(9999))
    assert rows(sv.trailing_background(outside, ring, cells, "2031-03")) == want
    assert rows(sv.trailing_background(df, ring, cells, "2031-01", 1))[1] == ("p", float(sum(n for c, m, n in counts if m == "2030-12" and c in "pq")))
