"""Building blocks for tables where one key, or one task, could see too much.

* ``global_running_sum`` ranks or prefix-sums a whole table in range
  partitions, instead of one unpartitioned window.
* ``exact_quantiles`` interpolates exactly on top of it.
* ``salted_join`` spreads the rows of a hot join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcell.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the lower 33 bits


def global_running_sum(df: DataFrame, order_by: list, weight: Column | None = None, name: str = "rn",
                       partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` over the total order ``order_by``.

    Without a weight this is a global row number. ``order_by`` must end in
    columns that make it total, so equal leading values still spread over
    several range partitions. The ranged rows are checkpointed once: partition
    bounds are sampled, and both the partition totals and the final rows have
    to see the same bounds. Unless ``partitions`` is given, adaptive execution
    merges small neighbouring ranges.
    """
    weighted = df.withColumn("_w", F.lit(1).cast("bigint") if weight is None else weight)
    ranged = (weighted.repartitionByRange(*([partitions] if partitions else []), *order_by)
              .sortWithinPartitions(*order_by)
              .withColumn("_seq", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged).withColumn("_pid", F.shiftright("_seq", _ROW_BITS))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, so this unpartitioned window stays tiny.
    offsets = (ranged.groupBy("_pid").agg(F.sum("_w").alias("_total"))
               .select("_pid", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")))
    out = ranged.join(F.broadcast(offsets), "_pid")
    if weight is None:
        inside = F.col("_seq") - F.shiftleft(F.col("_pid"), _ROW_BITS) + 1
    else:
        inside = F.sum("_w").over(Window.partitionBy("_pid").orderBy("_seq")
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn(name, F.col("_before") + inside).drop("_w", "_seq", "_pid", "_before")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], name: str = "quantiles") -> DataFrame:
    """One row: array of the linearly interpolated quantiles of ``value`` in ``probs`` order; nulls if there is no value.

    Equal values are folded to (value, count) before the sort. The order
    statistics around each position are then picked in one aggregate.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(
        F.count("*").alias("_c"))
    ranked = global_running_sum(counts, ["_v"], F.col("_c"), "_upto")
    total = ranked.agg(F.sum("_c").alias("_n"))
    start = F.col("_upto") - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < F.col("_upto")), F.col("_v")))

    picked, out = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        picked += [at(F.floor(pos)).alias(f"_a{i}"), at(F.ceil(pos)).alias(f"_b{i}"), F.max(pos - F.floor(pos)).alias(f"_f{i}")]
        out.append(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}"))
    return ranked.withColumn("_n", total.scalar()).agg(*picked).select(F.array(*out).alias(name))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str, spread: list, salts: int) -> DataFrame:
    """Equi-join whose hot keys are cut into ``salts`` parts.

    ``spread`` names columns of ``big`` (a row key) that pick the part, so a
    retried task picks the same one. Every row of ``small`` is copied once per part.
    """
    if salts <= 1:
        return big.join(small, on, how)
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to every core, also when they fill one small file and each is about to become many."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def tasks_for(rows: int, spark, per_task: int = 2_000_000) -> int:
    """Partitions of at most about ``per_task`` rows, one for each core at least: the rows of a task do not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def first_row(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Row with the smallest ``order`` tuple per key; partial minima run before the shuffle."""
    best = F.min(F.struct(*order, *keep)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *keep]])


def assert_empty(df: DataFrame, message: str) -> None:
    """Raise with a sample row when ``df`` has any."""
    bad = df.take(1)
    if bad:
        raise ValueError(f"{message}: {bad[0].asDict()}")
