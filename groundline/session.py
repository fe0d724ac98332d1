"""Session helpers: lineage cuts, size-checked broadcasts and scan pruning."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table (in rows) that is sent to every executor.
BROADCAST_ROWS = 200_000
# Largest key list pushed into a scan as an IN filter.
PRUNE_KEYS = 2_000


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests, the benchmark and the command line on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("groundline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; make one only if none is named."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="groundline-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`cut_lineage` for large tables: as compressed columns, several times smaller than a checkpoint's rows."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def has_copies(df: DataFrame, key: str | list[str]) -> bool:
    """True when two rows have the same ``key``, or none."""
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when a count proves the table small. The count stops at ``max_rows`` + 1 rows.

    Call it on a table that is cheap to count (a checkpoint, or an unmodified source).
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind :func:`fits_broadcast`; otherwise Spark shuffles the side."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use all cores when the input has fewer splits than the session has cores.

    Large inputs have more splits than cores and stay as they are, unless ``rows`` bounds what a task should hold: then the
    tasks grow with the count, which a file's footers give.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def text_bytes(df: DataFrame, column: str) -> int:
    """Total bytes of a text column; bounds the number of tokens it can hold."""
    row = df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()
    return int(row["n"])


def prune_scan(df: DataFrame, column: str, keys: DataFrame, max_keys: int = PRUNE_KEYS) -> DataFrame:
    """Push ``column IN (keys)`` into the scan of ``df`` when there are few distinct keys.

    The caller still joins on the keys, so the result is the same without the filter; with it
    Parquet skips the row groups whose statistics exclude every key.
    """
    rows = keys.select(column).distinct().limit(max_keys + 1).collect()
    if len(rows) > max_keys:
        return df
    return df.where(F.col(column).isin([r[0] for r in rows]))


def one(df: DataFrame) -> Column:
    """A one-row, one-column frame as a scalar subquery."""
    return df.scalar()
