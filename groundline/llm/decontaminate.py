"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed, a run of ``least`` words, are tiled: the longest common runs of words
that no earlier tile covers are marked first, found by running Karp-Rabin over windows whose length falls from round to
round. The share of an item's words under tiles tells whether a document contains it, in whatever order the
passages stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.segments import NO_WORD, passes, sequences, words

# Text of the items that are sent to the tasks at a time.
BLOCK_BYTES = 8_000_000
FIRST_WINDOW = 20


def _windows(values: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and rolling hashes of all windows without a mark."""
    hashes = sequences(values, size)
    sums = np.concatenate(([0], np.cumsum(marked)))
    starts = np.flatnonzero(sums[size:] == sums[: len(sums) - size]) if len(hashes) else np.zeros(0, np.int64)
    return starts, hashes[starts]


def _matches(item: np.ndarray, item_marks: np.ndarray, text: np.ndarray, text_marks: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(length, place in item, place in text) of all maximal common runs of at least ``size`` unmarked words."""
    p, p_hash = _windows(item, item_marks, size)
    t, t_hash = _windows(text, text_marks, size)
    order = np.argsort(p_hash, kind="stable")
    low = np.searchsorted(p_hash[order], t_hash, "left")
    count = np.searchsorted(p_hash[order], t_hash, "right") - low
    at_text = np.repeat(t, count)
    inside = np.arange(len(at_text)) - np.repeat(np.cumsum(count) - count, count)
    at_item = p[order[np.repeat(low, count) + inside]] if len(at_text) else at_text
    # windows that follow each other on a diagonal are one run
    diagonal = at_text - at_item
    order = np.lexsort((at_item, diagonal))
    at_item, at_text, diagonal = at_item[order], at_text[order], diagonal[order]
    new = np.ones(len(at_item), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (at_item[1:] != at_item[:-1] + 1)
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(at_item))) + size - 1
    return list(zip(lengths.tolist(), at_item[first].tolist(), at_text[first].tolist(), strict=True))


def tile(item: np.ndarray, text: np.ndarray, least: int, broken: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in text) of at least ``least`` words, longest first; ``broken`` marks places
    of the text that no tile may cover. Of equally long runs the one that is first in the item, then in the text, wins."""
    item_marks = np.zeros(len(item), bool)
    text_marks = np.zeros(len(text), bool) if broken is None else broken.copy()
    tiles, size = [], max(least, min(FIRST_WINDOW, len(item)))
    while True:
        found = _matches(item, item_marks, text, text_marks, size)
        longest = max((f[0] for f in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        queue = [(-length, p, t) for length, p, t in found]
        heapq.heapify(queue)
        while queue:
            length, p, t = heapq.heappop(queue)
            taken = item_marks[p : p - length] | text_marks[t : t - length]
            if not taken.any():
                item_marks[p : p - length] = text_marks[t : t - length] = True
                tiles.append((-length, p, t))
                continue
            # the parts that are still free queue again at their own lengths
            edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
            for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - start >= size:
                    heapq.heappush(queue, (start - end, p + start, t + start))
        if size == least:
            return sorted(tiles, key=lambda f: (-f[0], f[1], f[2]))
        size = max(least, size // 2)


class _Items:
    """Benchmark items as word hashes, and where each of their seeds stands."""

    def __init__(self, ids: list[int], columns: list[np.ndarray], least: int):
        self.ids, self.words, self.least = ids, columns, least
        seeds = [sequences(w, least) for w in columns]
        self.seeds = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        self.place = np.concatenate([*[np.arange(len(s)) for s in seeds], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owner, self.place = self.seeds[order], self.owner[order], self.place[order]

    def in_document(self, text: np.ndarray, hits: np.ndarray, seeds: np.ndarray, share: float) -> Iterator[tuple[int, int, int]]:
        """(number of the item, words under tiles, tiles) of the items that reach ``share``; ``hits``: places of known seeds."""
        low = np.searchsorted(self.seeds, seeds, "left")
        count = np.searchsorted(self.seeds, seeds, "right") - low
        rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at_text, owner, place = np.repeat(hits, count), self.owner[rows], self.place[rows]
        for number in np.unique(owner).tolist():
            item, mine = self.words[number], owner == number
            # tiles lie where seeds lie: too few of the item's words there, and no tiling reaches the share
            within = np.zeros(len(item) + 1, np.int64)
            np.add.at(within, place[mine], 1)
            np.add.at(within, place[mine] + self.least, -1)
            if (np.cumsum(within[:-1]) > 0).sum() < share * len(item):
                continue
            near = np.unique((np.unique(at_text[mine])[:, None] + np.arange(self.least)).ravel())
            gaps = np.flatnonzero(np.diff(near) > 1) + 1
            part = np.insert(text[near], gaps, np.uint64(0))
            broken = np.insert(np.zeros(len(near), bool), gaps, True)
            tiles = tile(item, part, self.least, broken)
            covered = sum(t[0] for t in tiles)
            if covered >= share * len(item):
                yield number, covered, len(tiles)


def _item_blocks(benchmark: DataFrame, least: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The items in blocks of about ``BLOCK_BYTES`` of text; one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text").toArrow()
        if mine.num_rows:
            hashes, rows = words(pc.utf8_lower(mine["text"].combine_chunks()), NO_WORD)
            columns = [hashes[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield mine["item_id"].to_pylist(), columns


def _found(batch: pa.RecordBatch, items: _Items, share: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, number of the item, words under tiles, tiles) of one batch."""
    hashes, rows = words(pc.utf8_lower(batch.column("text")), NO_WORD)
    seeds = sequences(hashes, items.least)
    if not len(items.seeds) or not len(seeds):
        return
    at = np.minimum(np.searchsorted(items.seeds, seeds), len(items.seeds) - 1)
    hits = np.flatnonzero(items.seeds[at] == seeds)
    cuts = np.searchsorted(hits, rows)
    for row in np.flatnonzero(np.diff(cuts)).tolist():
        mine = hits[cuts[row] : cuts[row + 1]]
        mine = mine[mine + items.least <= rows[row + 1]]  # not across two documents
        start = rows[row]
        for found in items.in_document(hashes[start : rows[row + 1]], mine - start, seeds[mine], share):
            yield row, *found


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, least: int = 5) -> DataFrame:
    """(doc_id, item_id, covered, words, coverage, tiles) of all documents and items with ``coverage`` of at least ``share``.

    Words are runs of letters and digits, lower-cased; whole texts count. Items of fewer than ``least`` words, null
    and empty texts match nothing; null ids are kept, repeated documents and items give repeated rows, other columns are
    ignored, empty tables give an empty result. No shuffle: the items come to the documents in blocks of bounded size.
    """
    spark, pairs = docs.sparkSession, None
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for ids, columns in _item_blocks(benchmark, least):
        shared = spark.sparkContext.broadcast((ids, columns))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _Items(*shared.value, least)
            for batch in passes(batches):
                found = list(_found(batch, items, share))
                rows = pa.array([f[0] for f in found], pa.int64())
                sizes = [len(items.words[f[1]]) for f in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), pa.array([items.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([f[2] / n for f, n in zip(found, sizes, strict=True)], pa.float64()), pa.array([f[3] for f in found], pa.int64()),
                ], names=["doc_id", "item_id", "covered", "words", "coverage", "tiles"])

        part = narrow.mapInArrow(run, PAIRS)
        pairs = part if pairs is None else pairs.unionByName(part)
    return spark.createDataFrame([], PAIRS) if pairs is None else pairs


PAIRS = "doc_id long, item_id long, covered long, words long, coverage double, tiles long"


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, least: int = 5) -> DataFrame:
    """(doc_id, n_items, items, coverage) of the documents that contain an item: all its items and the largest coverage."""
    pairs = contaminated_pairs(docs, benchmark, share, least)
    return pairs.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, least: int = 5) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    for ids, columns in _item_blocks(benchmark, least):
        shared = docs.sparkSession.sparkContext.broadcast((ids, columns))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _Items(*shared.value, least)
            for batch in passes(batches):
                clean = np.ones(batch.num_rows, bool)
                for found in _found(batch, items, share):
                    clean[found[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
