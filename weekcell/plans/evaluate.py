"""Metrics of predicted counts against the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcell.operators.scale import global_running_sum

METRICS = ["mean_poisson_deviance", "top_decile_capture", "obs_over_pred", "incidents", "predicted_incidents"]


def deviance_term(y: str = "y", mu: str = "mu") -> Column:
    """2 * (y ln(y/mu) - (y - mu)) per row; a prediction that is not finite and positive fails."""
    y_, m = F.col(y).cast("double"), F.col(mu)
    log_part = F.when(y_ > 0, y_ * F.ln(y_ / m)).otherwise(0.0)
    ok = (m > 0) & (m < float("inf"))
    return F.when(ok, 2 * (log_part - (y_ - m))).otherwise(
        F.raise_error(F.lit("predictions must be finite and > 0")).cast("double"))


def mean_poisson_deviance(y: str = "y", mu: str = "mu") -> Column:
    return F.avg(deviance_term(y, mu))


def slot_table(rows: DataFrame) -> DataFrame:
    """(cell, hour_of_week): y, mu, exposure summed, and the predicted rate."""
    return rows.groupBy("cell", "hour_of_week").agg(
        F.sum("y").alias("y"), F.sum("mu").alias("mu"), F.sum("exposure").alias("exposure")).withColumn(
        "rate", F.col("mu") / F.col("exposure"))


def ranked_slots(rows: DataFrame, places: int | None = None) -> DataFrame:
    """Slots numbered by falling rate, ties by (cell, hour_of_week); optionally on rounded rates."""
    slots = slot_table(rows)
    if places is not None:
        slots = slots.withColumn("rate", F.round("rate", places))
    return global_running_sum(slots, [F.col("rate").desc(), F.col("cell"), F.col("hour_of_week")])


def top_share(rows: DataFrame, share: float = 0.10, places: int | None = None) -> DataFrame:
    """The ceil(share * slots) slots with the highest predicted rate."""
    ranked = ranked_slots(rows, places)
    total = ranked.agg(F.count("*").alias("n"))
    return ranked.where(F.col("rn") <= F.ceil(F.lit(share) * total.scalar()))


def top_decile_capture(rows: DataFrame, share: float = 0.10, places: int | None = None) -> DataFrame:
    """One row: share of all incidents that fall in the top slots."""
    ranked = ranked_slots(rows, places)
    total = ranked.agg(F.count("*").alias("n"))
    top = F.sum(F.when(F.col("rn") <= F.ceil(F.lit(share) * total.scalar()), F.col("y")).otherwise(0))
    return ranked.agg(F.try_divide(top.cast("double"), F.sum("y").cast("double")).alias("top_decile_capture"))


def equal_bins(rank: Column, n: Column, bins: int = 10) -> Column:
    """1-based bin of a first-method rank: bins of equal size in quantile terms, not ntile."""
    return F.greatest(F.lit(1), F.ceil((rank - 1).cast("double") * bins / F.greatest(n - 1, F.lit(1)))).cast("int")


def calibration_table(rows: DataFrame, bins: int = 10, places: int | None = None) -> DataFrame:
    """Rows in equal-size bins of predicted rate: predicted against observed counts."""
    rate = F.col("mu") / F.col("exposure")
    rated = rows.withColumn("rate", rate if places is None else F.round(rate, places))
    ranked = global_running_sum(rated.select("cell", "month", "hour_of_week", "rate", "mu", "y"),
                                ["rate", "month", "cell", "hour_of_week"])
    n = ranked.agg(F.count("*").alias("n")).scalar()
    return (ranked.withColumn("decile", equal_bins(F.col("rn"), n, bins)).groupBy("decile").agg(
        F.count("*").alias("rows"), F.avg("rate").alias("mean_pred_rate"), F.sum("mu").alias("predicted"),
        F.sum("y").alias("observed"))
        .withColumn("observed_over_predicted", F.col("observed") / F.col("predicted")))


def evaluate(rows: DataFrame) -> DataFrame:
    """One row with every metric of the ledger."""
    basic = rows.agg(
        F.count("*").alias("rows"), F.sum("y").alias("incidents"), F.sum("mu").alias("predicted_incidents"),
        mean_poisson_deviance().alias("mean_poisson_deviance"),
        F.try_divide(F.sum("y").cast("double"), F.sum("mu")).alias("obs_over_pred"))
    return basic.withColumn("top_decile_capture", top_decile_capture(rows).scalar())


def by_group(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("y").alias("observed"), F.sum("mu").alias("predicted")).withColumn(
        "observed_over_predicted", F.try_divide(F.col("observed").cast("double"), F.col("predicted")))


def unseen_slots(rows: DataFrame, trained: DataFrame) -> DataFrame:
    """Rows whose (cell, hour_of_week) has no fitted rate."""
    return rows.join(trained.select("cell", "hour_of_week"), ["cell", "hour_of_week"], "left_anti")


def level_error(rows: DataFrame) -> DataFrame:
    """One row: mean absolute log of monthly observed over predicted."""
    monthly = rows.groupBy("month").agg(F.sum("y").alias("o"), F.sum("mu").alias("p"))
    return monthly.agg(F.avg(F.abs(F.ln(F.col("o") / F.col("p")))).alias("mean_abs_log_ratio"))


# -- ledger ----------------------------------------------------------------------


def latest_entries(ledger: DataFrame) -> DataFrame:
    """Newest ledger row per model version."""
    rest = [c for c in ledger.columns if c != "version"]
    return ledger.groupBy("version").agg(F.max_by(F.struct(*rest), "evaluated_at").alias("_e")).select("version", "_e.*")


def unpivot_metrics(df: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    wide = df.select("version", *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot("version", metrics, "metric", "value")


def metric_mismatches(results: DataFrame, ledger: DataFrame, rel: float = 1e-9,
                      metrics: list[str] = METRICS) -> DataFrame:
    """(version, metric, value, recorded) of known versions that do not reproduce."""
    now = unpivot_metrics(results, metrics)
    old = unpivot_metrics(latest_entries(ledger), metrics).withColumnRenamed("value", "recorded")
    gap = F.abs(F.col("value") - F.col("recorded"))
    return now.join(old, ["version", "metric"]).where(gap > rel * F.greatest(F.lit(1.0), F.abs("recorded")))


def new_versions(results: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("version",)) -> DataFrame:
    """Results whose keys the ledger does not hold: the only rows that may be appended."""
    return results.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def reevaluated(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """(version, digest, recorded) of known versions that come with a digest of other data than any they were recorded with."""
    known = ledger.select("version", F.col("digest").alias("recorded")).distinct()
    other = new_versions(results.select("version", "digest"), ledger, ("version", "digest"))
    return other.join(known, "version")


def record_once(path: str, results: DataFrame, metrics: list[str] = METRICS) -> None:
    """Append versions that the ledger does not hold; a known version is only verified.

    A known version whose metrics moved is an error. Where results carry a ``digest`` of the rows they were evaluated on, so is one that comes with other
    rows: a version is evaluated once. Nothing is written before both checks have passed.
    """
    from weekcell.operators.scale import assert_empty
    from weekcell.sources.versions import path_exists
    spark = results.sparkSession
    stamped = results.withColumn("evaluated_at", F.current_timestamp())
    if path_exists(spark, path):
        ledger = spark.read.parquet(path)
        if "digest" in results.columns:
            assert_empty(reevaluated(results, ledger), "a version was evaluated on other rows before")
        assert_empty(metric_mismatches(results, ledger, metrics=metrics), "recorded metrics do not reproduce")
        stamped = new_versions(stamped, ledger)
    stamped.write.mode("append").parquet(path)


def row_text(columns: list[str]) -> Column:
    """One text for a row that no other row of these columns has: each value with its length before it, nulls marked."""
    def told(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.when(value.isNull(), "n").otherwise(F.concat(F.lit("s"), F.char_length(value).cast("string"), F.lit(":"), value))
    return F.concat(*[told(c) for c in columns])


def digest(columns: list[str]) -> Column:
    """Aggregate: 128-bit content digest that ignores the order of rows and can be computed by any SQL engine.

    Each row's MD5 is cut into two numbers of 64 bits; both are summed as decimals, which doesn't overflow below 10**18 rows, and told with the count.
    Rows that occur twice count twice. Floating columns should be rounded to decimals by the caller.
    """
    h = F.md5(row_text(columns).cast("binary"))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return F.concat_ws("-", half(1).cast("string"), half(17).cast("string"), F.count("*").cast("string"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the ``digest`` of a table."""
    return df.agg(digest(columns).alias("fingerprint"))
