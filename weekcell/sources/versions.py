"""Versioned months: immutable folders of data and a manifest that names the current one of each month.

A writer puts its rows into a folder of its own (``_pull=<id>/month=<label>``) and then appends one small file to the manifest. Readers
start from the manifest, so rows without a manifest entry (a writer that died, or one still at work) do not exist for them, a month is never
seen half replaced, and two writers never meet in a folder. A reader's plan names the folders it read from the manifest, so it keeps its
snapshot however many pulls are published while it runs.

``publish`` refuses a pull whose months moved since it read them. Between this look and the manifest's file lies one small write; a store
written by several schedulers at once needs a lock around ``publish``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

MANIFEST = "month string, pull string, rows bigint, columns string, pulled_at timestamp, commit int"


@dataclass(frozen=True)
class Version:
    """The current data of a month; ``rows`` is 0 for an emptied month, which has no folder."""
    month: str
    pull: str
    rows: int
    columns: str

    def folder(self, path: str) -> str:
        return f"{path}/_pull={self.pull}/month={self.month}"


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as failed:
        if failed.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Every entry of the store's manifest, or None before the first pull."""
    where = f"{path.rstrip('/')}_manifest"
    return spark.read.schema(MANIFEST).json(where) if path_exists(spark, where) else None


def current(spark: SparkSession, path: str) -> dict[str, Version]:
    """Month -> its newest version: as many rows as the calendar has months. Empty for a store without a manifest."""
    entries = manifest(spark, path)
    if entries is None:
        return {}
    newest = entries.groupBy("month").agg(F.max_by(F.struct("pull", "rows", "columns"), F.struct("commit", "pull")).alias("v"))
    return {r["month"]: Version(r["month"], *r["v"]) for r in newest.collect()}


def _schema(versions: Iterable[Version]) -> T.StructType:
    """Columns of all versions, in order of appearance; a version without a column reads as null there."""
    fields: dict[str, T.StructField] = {}
    for text in dict.fromkeys(v.columns for v in sorted(versions, key=lambda v: v.month)):
        for field in T.StructType.fromJson(json.loads(text)).fields:
            fields.setdefault(field.name, T.StructField(field.name, field.dataType))
    return T.StructType([*(f for name, f in fields.items() if name != "month"), T.StructField("month", T.StringType())])


def read_versions(spark: SparkSession, path: str, versions: dict[str, Version], months: list[str] | None = None) -> DataFrame:
    """The rows of these versions, of some months or of all; folders of other months or versions are not listed."""
    schema, path = _schema(versions.values()), path.rstrip("/")
    folders = [v.folder(path) for m, v in sorted(versions.items()) if v.rows and (months is None or m in months)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*[f"`{c}`" for c in schema.names])


def write_pull(df: DataFrame, path: str, sort: list[str] | None = None) -> str:
    """Write ``df`` (with a column month) into a folder of its own, unseen until it is published; returns the pull's id.

    Rows of a month are spread over several files by the sort columns' range, so one heavy month is not one task.
    """
    pull = uuid.uuid4().hex
    out = df.repartitionByRange("month", *sort).sortWithinPartitions("month", *sort) if sort else df
    out.write.partitionBy("month").parquet(f"{path.rstrip('/')}/_pull={pull}")
    return pull


def publish(spark: SparkSession, path: str, pull: str, columns: T.StructType, months: list[str], base: dict[str, Version], now: datetime) -> None:
    """Make ``pull`` the current version of ``months``, those without rows included; fails if one of them is not at ``base`` any more."""
    path, at = path.rstrip("/"), current(spark, path)
    moved = sorted(m for m in months if at.get(m) != base.get(m))
    if moved:
        raise ValueError(f"another pull was published meanwhile for {moved}; read the months again")
    shape = T.StructType([*columns.fields, *([] if "month" in columns.names else [T.StructField("month", T.StringType())])])
    stored = spark.read.schema(shape).parquet(f"{path}/_pull={pull}").groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("rows"))
    asked = spark.createDataFrame([(m,) for m in months], "month string")
    entries = manifest(spark, path)
    number = 1 + (entries.agg(F.max("commit")).first()[0] if entries is not None else 0)
    rows = asked.join(stored, "month", "left").select(
        "month", F.lit(pull).alias("pull"), F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(columns.json()).alias("columns"),
        F.lit(now).cast("timestamp").alias("pulled_at"))
    # one file of calendar size: it is there or it is not
    rows.coalesce(1).write.mode("append").json(f"{path}_manifest/commit={number}")


def replace_months(spark: SparkSession, path: str, df: DataFrame, months: list[str], now: datetime, sort: list[str] | None = None) -> None:
    """``df`` becomes the whole content of ``months``; a month without rows in it is emptied."""
    base = current(spark, path)
    publish(spark, path, write_pull(df, path, sort), df.schema, months, base, now)


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """(month, pull) that are no longer current; their folders may go once no reader of an older snapshot runs."""
    entries = manifest(spark, path)
    newest = entries.groupBy("month").agg(F.max_by("pull", F.struct("commit", "pull")).alias("pull"))
    return entries.where("rows > 0").select("month", "pull").distinct().join(newest, ["month", "pull"], "left_anti")
