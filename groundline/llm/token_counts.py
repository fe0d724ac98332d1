"""Token counts of whole texts under a sentence-piece BPE model, by merging alone.

A chunk's symbols form a doubly linked list; a heap holds the adjacent pairs that make a piece, best score first,
leftmost first among equals. Popping a pair joins two symbols, so the count is the number of first symbols minus the
number of merges, and no id is ever looked up. Characters outside the vocabulary count as their bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.chunks import ChunkMemory, chunk_starts
from groundline.llm.segments import passes, text_bytes

SPACE = "▁"


class MergeRanks:
    """Scores of the pieces of a model, and the borders that no piece crosses."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        plain = [i for i in range(n) if not (library.is_unknown(i) or library.is_control(i) or library.is_byte(i))]
        self.scores = {library.id_to_piece(i): library.get_score(i) for i in plain}
        self.falls_to_bytes = any(library.is_byte(i) for i in range(n))
        beside = np.zeros((256, 256), bool)  # bytes that stand side by side in a piece; others part the text
        beside[128:, :] = beside[:, 128:] = True
        for piece in self.scores:
            raw = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            beside[raw[:-1], raw[1:]] = True
        self.apart = ~beside
        self.memory = ChunkMemory(self._measure)

    def _measure(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(chunks), np.int64), np.fromiter((self.count(c.decode()) for c in chunks), np.int32, len(chunks))

    def count(self, chunk: str) -> int:
        """Symbols left after all merges, each symbol outside the vocabulary counted by its bytes."""
        symbols = list(chunk.replace(" ", SPACE))
        scores, n = self.scores, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                heap.append((-score, i, symbols[i] + symbols[i + 1], i + 1))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, joined, k = heapq.heappop(heap)
            left, right = symbols[i], symbols[k]
            if left is None or right is None or len(left) + len(right) != len(joined) or after[i] != k:
                continue  # one of the two has been merged since
            symbols[i], symbols[k] = joined, None
            count -= 1
            end = after[i] = after[k]
            if end < n:
                before[end] = i
                score = scores.get(joined + symbols[end])
                if score is not None:
                    heapq.heappush(heap, (-score, i, joined + symbols[end], end))
            start = before[i]
            if start >= 0:
                score = scores.get(symbols[start] + joined)
                if score is not None:
                    heapq.heappush(heap, (-score, start, symbols[start] + joined, i))
        for s in symbols:
            if s is not None and len(s) == 1 and s not in scores and self.falls_to_bytes:
                count += len(s.encode()) - 1
        return count

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row; null and empty rows have none."""
        column = pc.fill_null(column, "")
        empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        # the library puts one blank before every text that isn't empty
        data, offsets = text_bytes(pc.binary_join_element_wise(pa.scalar(" "), column, pa.scalar("")))
        if not len(data):
            return np.zeros(len(column), np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = self.apart[data[:-1], data[1:]]
        starts = chunk_starts(data, offsets, cut)
        places = self.memory.places(data, starts, np.append(starts[1:], len(data)))
        sums = np.concatenate(([0], np.cumsum(self.memory.values[self.memory.firsts[places]], dtype=np.int64)))
        counts = np.diff(sums[np.searchsorted(starts, offsets)])
        counts[empty] = 0
        return counts


_ranks: dict[int, MergeRanks] = {}


def _merge_ranks(model: bytes) -> MergeRanks:
    key = hash(model)
    if key not in _ranks:
        _ranks.clear()
        _ranks[key] = MergeRanks(model)
    return _ranks[key]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs(doc_id, text)``; ``model`` is the model file's content.

    Null and empty texts have 0 tokens, a null ``doc_id`` and repeated rows stay as they are, other columns are
    ignored, an empty table gives an empty result. The work is row by row: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            ranks, text = _merge_ranks(shared.value), batch.column("text")
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            counts = ranks.counts(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
