"""Intermediate tables in the shared folder, and small sources that every task needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundline.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Rows of an Arrow batch; whole texts and sets of shingles are some kilobytes each.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep what a Python worker and its executor hold at a time small, unless the session says otherwise."""
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, BATCH_ROWS)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read on from there.

    Cuts the lineage: a lost executor costs only the tasks that were running on it. The files stay until the
    folder is cleaned, as checkpoint files do.
    """
    small_batches(df.sparkSession)
    folder = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, keys: list[str], order: list, values: list[str], label: str) -> DataFrame:
    """``df`` with ``before_<value>``: the sums of ``values`` over all earlier rows of the same ``keys``.

    A range partitioning by keys and order deals a hot key to many tasks. Each partition is summed on its own, and
    the totals of the partitions before it (a few rows a key) are joined back. ``order`` should tell rows apart;
    rows that it can't tell apart take any order among themselves.
    """
    ranks = [F.col(k).asc_nulls_last() for k in keys] + order
    placed = stored(
        df.repartitionByRange(partitions(df.sparkSession), *ranks).withColumn("__part", F.spark_partition_id()), label
    )
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    totals = totals.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"__sum_{v}").over(ahead), F.lit(0)).alias(f"__ahead_{v}") for v in values],
    )
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    sums = [F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__inside_{v}") for v in values]
    joined = placed.select("*", *sums).join(totals, same)
    return joined.select(*df.columns, *[(F.col(f"__inside_{v}") + F.col(f"__ahead_{v}")).alias(f"before_{v}") for v in values])
