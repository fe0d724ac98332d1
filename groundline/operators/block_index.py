"""A stored inverted index whose rows carry score bounds, and the exact best ``k`` from a small part of it.

A term's postings lie in blocks from the largest weight to the smallest; a row is one block with its largest weight
apart from the packed chunks and weights, so bounds are read without the payload. A second table holds each chunk's own
terms. A search first scores a few promising chunks, whose ``k``-th best score bounds every list from below. Terms
that together can't lift a chunk to that bound need no reading at all, and of the other terms only the blocks that can. The
chunks found there are looked up in the second table, and only the ones that may still reach the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.operators.ranking import best_first, rounded, top_k
from groundline.session import broadcast_if_small, cut_lineage, prune_scan

BLOCK_POSTINGS = 128
# Postings that the first look of a list reads, and chunks that it scores, for each of its k places.
FIRST_LOOK, LIKELY = 40, 4
# Terms that could lift a chunk to this share of the bound are read: fewer blocks near 1, fewer chunks to look up below.
EAGER = 0.9
# Scores are sums of rounded terms: bounds give way by this much.
SLACK = 1e-6


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of one term, cut every ``size`` rows; batches come sorted by term and falling weight."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, weight = batch.column("term"), batch.column("weight").to_numpy()
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % size == 0
        starts = np.flatnonzero(new)
        offsets = pa.array(np.append(starts, n), pa.int32())
        yield pa.RecordBatch.from_arrays([
            term.take(pa.array(starts)), pa.array(np.diff(np.append(starts, n)).astype(np.int32)), pa.array(weight[starts]),
            pa.ListArray.from_arrays(offsets, batch.column("child_id")), pa.ListArray.from_arrays(offsets, pa.array(weight)),
        ], names=["term", "size", "top", "chunks", "weights"])


@dataclass
class BlockIndex:
    """``blocks(term, block, size, top, chunks, weights)`` and ``forward(child_id, issuer_key, entries)``."""

    blocks: DataFrame
    forward: DataFrame

    @classmethod
    def build(cls, postings: DataFrame, size: int = BLOCK_POSTINGS) -> BlockIndex:
        """From stored postings(term, child_id, issuer_key, weight) with weights of zero or more.

        Rows are dealt by ranges of (term, falling weight), so a frequent term spreads over many tasks, each of which
        packs its own stretch of it.
        """
        order = [F.col("term").asc(), F.col("weight").desc(), F.col("child_id").asc()]
        dealt = postings.select("term", "child_id", "weight").repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = dealt.mapInArrow(lambda batches: _packed(batches, size), "term string, size int, top double, chunks array<string>, weights array<double>")
        # one shuffle gathers a chunk's terms and orders the chunks
        forward = postings.repartitionByRange("child_id").groupBy("child_id", "issuer_key").agg(F.collect_list(F.struct("term", "weight")).alias("entries"))
        return cls(blocks.select("term", F.monotonically_increasing_id().alias("block"), "size", "top", "chunks", "weights"), forward)

    def save(self, path: str) -> None:
        """Write both tables, replacing what is there; files keep the order by term, so other terms' row groups are skipped."""
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        self.forward.sortWithinPartitions("child_id").write.mode("overwrite").parquet(f"{path}/forward")

    @classmethod
    def load(cls, spark, path: str) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/forward"))

    def search(self, query_terms: DataFrame, by: list[str], k: int) -> DataFrame:
        """(by, issuer_filter, child_id, issuer_key, score): the ``k`` best chunks of each list, ties to the smaller id.

        ``query_terms`` is (by, issuer_filter, term, query_weight) with weights above zero. Terms that the index lacks are ignored.
        """
        return self.searched(query_terms, by, k)[0]

    def searched(self, query_terms: DataFrame, by: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The rows of :meth:`search`; (by, block) of all blocks of the lists' terms; and of the blocks that were read."""
        asked = cut_lineage(query_terms.select(*by, "issuer_filter", "term", "query_weight"))
        asked = broadcast_if_small(asked)
        blocks = prune_scan(self.blocks, "term", asked)
        gain = F.col("query_weight") * F.col("top")
        # bounds only: the payload columns are not read
        heads = cut_lineage(blocks.select("term", "block", "size", "top").join(asked, "term").select(*by, "term", "block", "size", gain.alias("gain")))

        # first look: the blocks of the largest gains
        run = Window.partitionBy(*by).orderBy(F.col("gain").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("size").over(run), F.lit(0))
        first = cut_lineage(heads.withColumn("ahead", ahead).where(F.col("ahead") < FIRST_LOOK * k).select(*by, "block"))
        partial = self._partial(blocks, asked, first, by)
        likely = cut_lineage(top_k(partial, by, best_first("partial", "child_id"), LIKELY * k).select(*by, "child_id"))
        kth = top_k(self._scored(likely, asked, by), by, best_first("score", "child_id"), k)
        bound = kth.groupBy(*by).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bound"))

        # which terms and blocks can still matter
        most = heads.groupBy(*by, "term").agg(F.max("gain").alias("most"))
        rising = Window.partitionBy(*by).orderBy("most", "term")
        summed = most.join(bound, by, "left").select(
            *by, "term", "most", (F.coalesce("bound", F.lit(0.0)) - SLACK).alias("bound"), F.sum("most").over(rising).alias("upto"),
            F.sum("most").over(Window.partitionBy(*by)).alias("whole"))
        terms = cut_lineage(summed.withColumn("needed", F.col("upto") >= EAGER * F.col("bound")))
        rest = terms.groupBy(*by).agg(F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))), F.lit(0.0)).alias("rest"), F.first("bound").alias("bound"))
        open_blocks = heads.join(terms.where("needed"), [*by, "term"]).where(F.col("gain") + F.col("whole") - F.col("most") >= F.col("bound")).select(*by, "block")
        read = cut_lineage(open_blocks)
        found = self._partial(blocks, asked.join(terms.where("needed").select(*by, "term"), [*by, "term"]), read, by)
        candidates = cut_lineage(found.join(rest, by).where(F.col("partial") + F.col("rest") >= F.col("bound")).select(*by, "child_id"))
        best = top_k(self._scored(candidates, asked, by), by, best_first("score", "child_id"), k).drop("rank")
        return best, heads.select(*by, "block"), first.unionByName(read).distinct()

    @staticmethod
    def _partial(blocks: DataFrame, asked: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
        """(by, child_id, partial): what the chosen blocks add to each chunk."""
        lists = broadcast_if_small(chosen)
        rows = blocks.join(lists, "block").join(asked, [*by, "term"])
        each = rows.select(*by, "query_weight", F.explode(F.arrays_zip("chunks", "weights")).alias("p"))
        return each.groupBy(*by, F.col("p.chunks").alias("child_id")).agg(F.sum(F.col("query_weight") * F.col("p.weights")).alias("partial"))

    def _scored(self, candidates: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
        """(by, issuer_filter, child_id, issuer_key, score) of candidate chunks, from the chunks' own terms."""
        rows = self.forward.join(broadcast_if_small(candidates), "child_id")
        each = rows.select(*by, "child_id", "issuer_key", F.explode("entries").alias("e")).select(*by, "child_id", "issuer_key", "e.term", "e.weight")
        return each.join(asked, [*by, "term"]).groupBy(*by, "issuer_filter", "child_id", "issuer_key").agg(
            rounded(F.sum(F.col("query_weight") * F.col("weight"))).alias("score"))
