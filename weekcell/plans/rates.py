"""Two-level empirical-Bayes rates per (cell, hour of week)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weekcell.operators.scale import assert_empty

LOG_B_BOUNDS = (0.0, 20.0)
GRID_POINTS = 101
GRID_STEPS = 3  # log b to about 1e-4


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series after moving x up by 8."""
    z = x + 8
    shift = F.ln(x)
    for k in range(1, 8):
        shift = shift + F.ln(x + k)
    inv = 1 / z
    series = inv / 12 - F.pow(inv, 3) / 360 + F.pow(inv, 5) / 1260 - F.pow(inv, 7) / 1680 + F.pow(inv, 9) / 1188
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def loglik_term(b: Column, y: Column, e: Column, prior: Column) -> Column:
    """Log-likelihood of a slot total under Gamma(b * prior, b) mixing, without the part free of b."""
    a = b * prior
    seen = F.when(y > 0, log_gamma(a + y) - log_gamma(a)).otherwise(0.0)
    return seen + a * F.ln(b / (b + e)) + y * F.ln(e / (b + e))


def compressed(slots: DataFrame) -> DataFrame:
    """Distinct (y, exposure, prior) with their number: slots repeat the same few triples."""
    return slots.where(F.col("exposure") > 0).groupBy(
        F.col("y").cast("double").alias("y"), F.col("exposure").cast("double").alias("exposure"), "prior").agg(
        F.count("*").alias("n"))


def loglik_grid(triples: DataFrame, log_b: list[float]) -> DataFrame:
    """(log_b, loglik) for every grid value, in one pass over the triples."""
    grid = F.explode(F.array(*[F.lit(v) for v in log_b])).alias("log_b")
    term = loglik_term(F.exp("log_b"), F.col("y"), F.col("exposure"), F.col("prior"))
    return (triples.select("*", grid).groupBy("log_b").agg(F.sum(F.col("n") * term).alias("loglik")))


def fit_strength(slots: DataFrame, bounds: tuple[float, float] = LOG_B_BOUNDS, points: int = GRID_POINTS,
                 steps: int = GRID_STEPS) -> float:
    """b that maximises the marginal likelihood: a grid over log b, narrowed around its best value.

    Only the grid's best value comes back to the driver after each pass.
    """
    triples = compressed(slots).persist()
    try:
        lo, hi = bounds
        for _ in range(steps):
            width = (hi - lo) / (points - 1)
            grid = [lo + i * width for i in range(points)]
            best = loglik_grid(triples, grid).agg(F.max_by("log_b", "loglik").alias("b")).first()["b"]
            if best is None:
                raise ValueError("no slots with exposure")
            lo, hi = max(bounds[0], best - width), min(bounds[1], best + width)
        return math.exp(best)
    finally:
        triples.unpersist()


def posterior_rate(y: Column, e: Column, prior: Column, b: float | Column) -> Column:
    return (y + b * prior) / (e + b)


def slot_totals(train: DataFrame, boroughs: DataFrame) -> DataFrame:
    return (train.groupBy("cell", "hour_of_week").agg(F.sum("y").alias("y"), F.sum("exposure").alias("exposure"))
            .join(boroughs, "cell", "left"))


def borough_priors(slots: DataFrame) -> DataFrame:
    """(boro, hour_of_week, y, exposure, prior): the prior is the borough's overall rate."""
    hours = slots.groupBy("boro", "hour_of_week").agg(F.sum("y").alias("y"), F.sum("exposure").alias("exposure"))
    overall = hours.groupBy("boro").agg((F.sum("y") / F.sum("exposure")).alias("prior"))
    return hours.join(overall, "boro")


@dataclass
class SlotRates:
    """Fitted rates: ``slots`` per (cell, hour_of_week) and ``hours`` per (boro, hour_of_week)."""
    b_borough: float
    b_cell: float
    hours: DataFrame
    slots: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, boroughs: DataFrame) -> "SlotRates":
        # Slot totals are the smallest form of the training panel and feed every step below.
        totals = slot_totals(train, boroughs).persist()
        assert_empty(totals.where(F.col("boro").isNull()), "cell without a borough in training data")
        hours = borough_priors(totals)
        b_borough = fit_strength(hours)
        hours = hours.withColumn("rate", posterior_rate(F.col("y"), F.col("exposure"), F.col("prior"), b_borough))
        slots = totals.join(hours.select("boro", "hour_of_week", F.col("rate").alias("prior")), ["boro", "hour_of_week"])
        b_cell = fit_strength(slots)
        slots = slots.withColumn("rate", posterior_rate(F.col("y"), F.col("exposure"), F.col("prior"), b_cell))
        return cls(b_borough, b_cell, hours.select("boro", "hour_of_week", "rate"),
                   slots.select("cell", "hour_of_week", "boro", "y", "exposure", "prior", "rate"))

    def predict(self, rows: DataFrame, boroughs: DataFrame) -> DataFrame:
        return predict_rate(rows, boroughs, self.slots, self.hours)


def predict_rate(rows: DataFrame, boroughs: DataFrame, slots: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows with ``rate``: the slot's own, else its borough and hour's; neither is an error."""
    own = slots.select("cell", "hour_of_week", F.col("rate").alias("_own"))
    fallback = boroughs.join(hours.select("boro", "hour_of_week", F.col("rate").alias("_fallback")), "boro").drop("boro")
    both = rows.join(own, ["cell", "hour_of_week"], "left").join(fallback, ["cell", "hour_of_week"], "left")
    rate = F.coalesce("_own", "_fallback", F.raise_error(F.lit("row without a rate: cell without borough")).cast("double"))
    return both.withColumn("rate", rate).drop("_own", "_fallback")


def constant_rate(train: DataFrame) -> DataFrame:
    return train.agg((F.sum("y").cast("double") / F.sum("exposure")).alias("rate"))
