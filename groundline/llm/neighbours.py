"""Nearest neighbours with one vantage-point tree for each shard of the vectors.

A node holds a vantage vector and the median distance of its shard's other vectors to it; those nearer form one child,
the rest the other. With t the distance of a query's k-th best so far, the triangle inequality excludes the child on
the far side when |d - median| > t. The relaxed rule excludes it when |d - median| > t / factor: factor 1 is exact,
larger factors skip more and may miss neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundline.llm.storage import stored

LEAF = 64
# Vectors of one tree, and bytes of the queries that meet the trees in one pass.
SHARD_VECTORS = 20_000
QUERY_BYTES = 16_000_000


def usable(vector: str):
    """Vectors with components, all finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) > 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def build_tree(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, and for each inner node its median radius and middle.

    Nodes are the halves of the ordered points: node (a, b) has its vantage point at a, its near child in
    (a + 1, middle) and its far child in (middle, b).
    """
    order = np.arange(len(points))
    radius, stack = np.zeros(len(points)), [(0, len(points))]
    middles = np.zeros(len(points), np.int64)
    while stack:
        a, b = stack.pop()
        if b - a <= LEAF:
            continue
        pick = a + int(rng.integers(b - a))
        order[a], order[pick] = order[pick], order[a]
        inside = order[a + 1 : b]
        distance = np.sqrt(((points[inside] - points[order[a]]) ** 2).sum(axis=1))
        by = np.argsort(distance, kind="stable")
        half = len(by) // 2
        order[a + 1 : b] = inside[by]
        radius[a], middles[a] = distance[by[half]], a + 1 + half
        stack += [(a + 1, a + 1 + half), (a + 1 + half, b)]
    return order, radius, middles


class _Best:
    """The k nearest of each query so far, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        self.distance = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Distances of the rows' queries to the points, after entering them."""
        found = np.sqrt(((self.queries[rows][:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
        seen = np.where(self.own[rows][:, None] == ids[None, :], np.inf, found)
        better = (seen <= self.distance[rows, -1][:, None]).any(axis=1)
        if better.any():
            at = rows[better]
            every = np.concatenate([self.distance[at], seen[better]], axis=1)
            names = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
            names = np.where(np.isinf(every), np.iinfo(np.int64).max, names)
            first = np.lexsort((names, every), axis=1)[:, : self.k]
            self.distance[at] = np.take_along_axis(every, first, 1)
            self.ids[at] = np.take_along_axis(names, first, 1)
        return found


def search_tree(points: np.ndarray, ids: np.ndarray, tree, best: _Best, factor: float) -> None:
    """Enter the nearest of a shard for all queries of ``best``; queries go down the tree together."""
    order, radius, middles = tree
    points, ids = points[order], ids[order]

    def visit(a: int, b: int, rows: np.ndarray) -> None:
        if not len(rows) or a >= b:
            return
        if b - a <= LEAF:
            for start in range(0, len(rows), 512):
                best.offer(rows[start : start + 512], points[a:b], ids[a:b])
            return
        distance = best.offer(rows, points[a : a + 1], ids[a : a + 1])[:, 0]
        near = distance < radius[a]
        inner, outer = (a + 1, middles[a]), (middles[a], b)
        visit(*inner, rows[near])
        visit(*outer, rows[~near])
        # a little slack, so that rounding never excludes an equal distance
        within = np.abs(distance - radius[a]) <= best.distance[rows, -1] / factor * (1 + 1e-12) + 1e-12
        visit(*outer, rows[near & within])
        visit(*inner, rows[~near & within])

    visit(0, len(points), np.arange(len(best.queries)))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, ids: str = "vec_id", vector: str = "embedding", shard_vectors: int = SHARD_VECTORS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each query by Euclidean distance.

    Both frames hold ``ids`` and ``vector``; a query's own id is no candidate. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do null ids; vectors of other lengths than the query's are
    never compared. Ties go to the smaller id; a repeated row counts once for each time it stands there, up to ties.
    Fewer candidates than ``k`` are all returned; an empty table gives no row. Other columns are ignored.

    The trees are built once and stored. Queries meet them in passes of bounded size, each sent to all tasks; every
    tree gives ``k`` rows a query, which are merged by query.
    """
    spark = vectors.sparkSession
    clean = vectors.where(usable(vector) & F.col(ids).isNotNull()).select(
        F.col(ids).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    ).withColumn("dim", F.size("vector"))
    asked = queries.where(usable(vector) & F.col(ids).isNotNull()).select(
        F.col(ids).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector")
    ).withColumn("dim", F.size("vector"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tree(dim: int, parts: list) -> pa.RecordBatch:
            names = np.concatenate([p[0] for p in parts])
            points = np.concatenate([p[1] for p in parts])
            order, radius, middles = build_tree(points, np.random.default_rng(len(points)))
            blobs = [names.tobytes(), points.tobytes(), order.tobytes(), radius.tobytes(), middles.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=NAMES)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                parts = held.setdefault(dim, [])
                parts.append((part.column("vec_id").to_numpy(), _matrix(part.column("vector"))))
                if sum(len(p[0]) for p in parts) >= shard_vectors:
                    yield tree(dim, held.pop(dim))
        for dim, parts in held.items():
            yield tree(dim, parts)

    NAMES = ["dim", "ids", "points", "order", "radius", "middles"]
    index = stored(clean.mapInArrow(trees, "dim int, ids binary, points binary, order binary, radius binary, middles binary"), "vp-trees")
    found = None
    for block in _blocks(asked):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    dim, names, points, order, radius, middles = (batch.column(n)[row].as_py() for n in NAMES)
                    if dim not in shared.value:
                        continue
                    own, vectors = shared.value[dim]
                    best = _Best(vectors, own, k)
                    tree = np.frombuffer(order, np.int64), np.frombuffer(radius), np.frombuffer(middles, np.int64)
                    search_tree(np.frombuffer(points).reshape(-1, dim), np.frombuffer(names, np.int64), tree, best, factor)
                    full = np.isfinite(best.distance)
                    number = np.broadcast_to(np.arange(len(own))[:, None], full.shape)[full]
                    mark = number + (dim << 32)  # tells repeated queries apart
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[number]), pa.array(mark), pa.array(best.ids[full]), pa.array(best.distance[full])],
                        names=["query_id", "number", "vec_id", "score"],
                    )

        part = stored(index.mapInArrow(search, "query_id long, number long, vec_id long, score double"), "vp-found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id", "number").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(asked: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries in blocks of bounded size: by length of vector, ids and vectors. One block at a time is on the driver."""
    queries = stored(asked, "vp-queries")
    size = queries.agg(F.sum(8 * F.col("dim") + 8)).first()[0] or 0
    count = int(-(-size // QUERY_BYTES))
    for number in range(count):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == number).orderBy("query_id").toArrow()
        block = {}
        for dim in np.unique(mine["dim"].to_numpy()).tolist():
            part = mine.filter(pa.compute.equal(mine["dim"], dim)).combine_chunks()
            ids = part["query_id"].to_numpy()
            block[dim] = (ids, _matrix(part["vector"].combine_chunks()))
        yield block
