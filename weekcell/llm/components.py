"""Connected components over edge tables by alternating large stars and small stars, and a written table between rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcell.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: no later loss of an executor reruns what made it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hub(edges: DataFrame) -> DataFrame:
    """Edges with the least neighbour of their first end; pre-aggregated, so that a hub's edges may lie in many tasks."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v), root being the least node of its component (itself included)."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_hub(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        small = _hub(large)
        edges = written(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # a star forest is the one state that a round leaves as it is
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select("u", F.col("v").alias("root")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
