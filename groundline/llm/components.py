"""Connected components of a link table: chunks of links are contracted where they lie, then alternating stars join what
is left, each step a shuffle of the links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.storage import stored

# Links that one task contracts at a time (a few MB).
CHUNK_LINKS = 200_000


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node of a task's links with the smallest node that those links join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in parent if root(x) != x]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star: larger neighbours, then all smaller ones, move to the smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of all nodes of ``links(a, b)``; a component is named by its smallest node.

    ``links`` may hold repeats, both directions and self-links (ignored). A hub of any degree only ever meets its own
    minimum, which partial aggregation finds.
    """
    edges = stored(links.where("a <> b").select("a", "b"), label)
    count, tasks = edges.count(), 2
    while count and tasks > 1:
        tasks = -(-count // CHUNK_LINKS)
        edges, before = stored(_contracted(edges, tasks), label), count
        count = edges.count()
        if count > 0.5 * before:
            break
    state = None
    while count and tasks > 1:
        after = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if after == state:
            break
        state = after
        edges = stored(_stars(edges), label)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
