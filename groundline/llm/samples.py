"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, divisor: int, equal: int):
    """Whether crc32 of the column as text leaves ``equal``; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor == equal, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``docs`` joined with ``label`` and ``weight`` for up to ``per_class`` documents of each class.

    ``labels`` holds (doc_id, 0 or 1); other values and nulls are no labels, of repeated ones the largest counts. The
    sample is the same in every run: documents in the order of a hash of their id. ``weight`` is the number of labelled
    documents that a sampled one stands for. 2 * ``per_class`` ids at most are chosen, so they may be sent to all tasks.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("label"))
    )
    totals = dict(known.groupBy("label").count().collect())
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        weight = max(1.0, totals.get(value, 0) / per_class)
        part = part.withColumn("weight", F.lit(weight))
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__id"]).drop("__id")
