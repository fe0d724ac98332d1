"""Chunk vectors: the binary vector file, alignment by position, and precomputation."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions.text import issuer_key

RECORDS_PER_TASK = 100_000
# How passages are handed to the encoder.
PASSAGE_PREFIX = "passage: "


def read_vector_file(spark: SparkSession, path: str) -> DataFrame:
    """(ord, vec) of a file: u64 count, then per vector u64 length and f32 values, little-endian.

    All vectors have one length, so every task seeks to its own records. The path must be a folder
    that all executors mount.
    """
    with open(path, "rb") as handle:
        head = handle.read(16)
    count = struct.unpack("<Q", head[:8])[0]
    if count == 0:
        return spark.createDataFrame([], "ord long, vec array<float>")
    dim = struct.unpack("<Q", head[8:16])[0]
    record = np.dtype([("dim", "<u8"), ("vec", "<f4", (dim,))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"]:
                first = int(block) * RECORDS_PER_TASK
                todo = min(RECORDS_PER_TASK, count - first)
                data = np.fromfile(path, dtype=record, count=todo, offset=8 + first * record.itemsize)
                if len(data) != todo or (data["dim"] != dim).any():
                    raise ValueError(f"{path}: truncated, or vectors of different lengths")
                yield pd.DataFrame({"ord": np.arange(first, first + todo), "vec": list(data["vec"])})

    blocks = -(-count // RECORDS_PER_TASK)
    return spark.range(0, blocks, 1, min(blocks, 10_000)).mapInPandas(read, "ord long, vec array<float>")


def with_position(children: DataFrame) -> DataFrame:
    """Children with ``ord``, their place in corpus order, without sorting in one task.

    Rows are range-sorted; each task numbers its own rows and adds the sizes of the tasks before it.
    """
    ordered = children.orderBy("document", "page", "p_idx", "c_idx").withColumn(
        "__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()).persist()
    sizes = {r["__part"]: r["count"] for r in ordered.groupBy("__part").count().collect()}
    offsets, seen = {}, 0
    for part in sorted(sizes):
        offsets[part] = seen
        seen += sizes[part]
    if not offsets:
        return ordered.withColumn("ord", F.col("__id")).drop("__id", "__part")
    lookup = F.create_map(*[F.lit(v) for pair in offsets.items() for v in pair])
    row_in_part = F.col("__id").bitwiseAND((1 << 33) - 1)
    return ordered.withColumn("ord", row_in_part + lookup[F.col("__part")]).drop("__id", "__part")


def align_by_position(children: DataFrame, vectors: DataFrame,
                      dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(child_id, issuer_key, vec) from vectors stored in corpus order."""
    placed = with_position(children).select(
        "ord", "child_id", issuer_key(F.col("issuer"), dictionary).alias("issuer_key"))
    return placed.join(vectors, "ord").select("child_id", "issuer_key", "vec")


def compute_vectors(children: DataFrame, encode: Callable[[list[str]], np.ndarray],
                    dictionary: Dictionary = DEFAULT_DICTIONARY, batch_size: int = 256,
                    max_chars: int | None = None) -> DataFrame:
    """(child_id, issuer_key, vec): unit-length vectors from an injected encoder, by Arrow batch.

    The encoder gets whole texts; ``max_chars`` cuts them to an input window that the caller names.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), batch_size):
                texts = [PASSAGE_PREFIX + t[:max_chars] for t in batch.iloc[at:at + batch_size]]
                matrix = np.asarray(encode(texts), dtype="float32")
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                out += list(np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0))
            yield pd.Series(out, index=batch.index)

    return children.select(
        "child_id", issuer_key(F.col("issuer"), dictionary).alias("issuer_key"),
        run(F.col("content")).alias("vec"))
