"""Stage outputs: tables that several steps read are written once, in the folder of the checkpoints.

Every executor can read them, so losing one costs no recomputation of the stages before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weekcell.session import ensure_checkpoint_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame],
           sort: list[str] | None = None) -> DataFrame:
    """The table ``name`` of input folder ``d``, written on first use in range order of ``sort`` (or as it comes).

    Sorted files keep narrow value ranges per row group, so later filters skip most of them.
    """
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        path = scratch(spark, name)
        df = build()
        if sort:
            df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        df.write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
