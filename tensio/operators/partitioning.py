"""Partition-level helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tensio.session import ensure_checkpoint_dir, ship_package


class _Held:
    """Stand-in for a broadcast variable where none can be made (``.value`` only)."""

    def __init__(self, value):
        self.value = value


def share(spark, value):
    """Ship a bounded driver-side value to the executors once: a broadcast variable, or,
    on a session without a SparkContext (Spark Connect), the value itself, which then
    travels with the function that uses it."""
    ship_package(spark)
    try:
        return spark.sparkContext.broadcast(value)
    except Exception:  # noqa: BLE001 - no JVM SparkContext behind this session
        return _Held(value)


def spread_for_cpu(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan over more tasks when it yields fewer partitions than cores.

    Text cleaning is CPU-bound.  A small Parquet file with one row group is read by one
    task, which would run the whole regex chain serially.  The check is metadata-only and
    spreads only when that at least doubles the number of tasks; on a large input (many
    more splits than cores) it returns ``df`` unchanged, so no shuffle is added at scale.
    """
    spark = df.sparkSession
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD API (Spark Connect): leave the plan as is
        return df
    if have * 2 > want:  # spread only when it at least doubles the parallelism
        return df
    return df.repartition(want)


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and continue from the copy.

    Used at stage boundaries whose output is read several times (e.g. the labelled corpus
    that balancing reads), so the upstream cleaning and scoring run once.  Later reads take
    only the columns they need.  The copy lives in ``spark.checkpoint.dir`` (shared storage on
    a cluster), so it survives the loss of an executor; it stays until that folder is cleared.
    ``schema`` names other types of the same stored form to read it with (a vector's struct).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
