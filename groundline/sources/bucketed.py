"""Corpus and text index as bucketed tables, for a store that many batches of questions read.

Postings and chunk places are bucketed by chunk, chunk texts and parents by page. A sum by chunk and a join by chunk or page
then finds the stored side in place: only the asking side is exchanged, however large the corpus is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from groundline.operators.index import TextIndex

# Bucket keys and order within a bucket.
LAYOUT = {
    "parents": (["document", "page", "issuer"], ["document", "page"]),
    "children": (["document", "page"], ["document", "page"]),
    "places": (["child_id"], ["child_id"]),
    "tfidf": (["child_id"], ["term"]),
    "bm25": (["child_id"], ["term"]),
}
PLACE = ["child_id", "parent_id", "document", "page", "issuer", "p_idx", "is_toc"]


@dataclass
class BucketedStore:
    """``places`` are the chunks without their texts; ``index.vocabulary`` and ``index.titles`` are looked up by word and lie sorted."""

    parents: DataFrame
    children: DataFrame
    places: DataFrame
    index: TextIndex

    @classmethod
    def write(cls, parents: DataFrame, children: DataFrame, index: TextIndex, folder: str, name: str, buckets: int | None = None) -> "BucketedStore":
        """Tables ``<name>_parents`` and so on in the session's catalog, with their files below ``folder``, replacing what is there.

        ``buckets`` should give buckets of some hundred megabytes. Fewer than ``spark.sql.shuffle.partitions``
        (the default) would let Spark exchange both sides of a join to win tasks.
        """
        spark = parents.sparkSession
        if not re.fullmatch(r"\w+", name):
            raise ValueError("a store's name is part of table names")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        tables = {"parents": parents, "children": children, "places": children.select(*PLACE), "tfidf": index.tfidf, "bm25": index.bm25}
        for table, (keys, order) in LAYOUT.items():
            # The same hash as the buckets': every task writes whole buckets, one file each.
            tables[table].repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*order).mode("overwrite").option(
                "path", f"{folder}/{table}").saveAsTable(f"{name}_{table}")
        for table, key in (("vocabulary", "term"), ("titles", "token")):
            getattr(index, table).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option(
                "path", f"{folder}/{table}").saveAsTable(f"{name}_{table}")
        return cls.open(spark, name)

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> "BucketedStore":
        read = {table: spark.table(f"{name}_{table}") for table in [*LAYOUT, *TextIndex.TABLES]}
        return cls(read["parents"], read["children"], read["places"], TextIndex(*[read[t] for t in TextIndex.TABLES]))
