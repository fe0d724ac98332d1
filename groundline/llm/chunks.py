"""Texts as runs of chunks that a tokenizer handles one by one, each different chunk once.

Both tokenizers here never join characters across certain borders, so a text's tokens are those of its chunks in
turn. What a worker process has learnt about a chunk is kept for its later batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from groundline.llm.segments import ragged, span_hashes

# Chunks that a worker process remembers (about 30 bytes each, without the ids).
REMEMBERED = 2_000_000


def chunk_starts(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Starts of all chunks: of each row, and wherever ``cut`` is set."""
    begin = cut.copy()
    begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(begin)


class ChunkMemory:
    """Values of chunks by hash; ``measure`` gives the number of values of each new chunk, and all values in turn."""

    def __init__(self, measure: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED):
        self.measure, self.limit = measure, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.firsts, self.lengths, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each chunk its place in ``firsts`` and ``lengths``."""
        distinct, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if len(self.keys) and len(self.keys) + int((~known).sum()) > self.limit:
            self._clear()
            known[:] = False
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            lengths, values = self.measure([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            total = len(self.values)
            ids = np.arange(len(self.lengths), len(self.lengths) + len(new))
            self.firsts = np.concatenate([self.firsts, total + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.values = np.concatenate([self.values, values]).astype(np.int32)
            keys, where = np.concatenate([self.keys, distinct[~known]]), np.concatenate([self.where, ids])
            order = np.argsort(keys, kind="stable")
            self.keys, self.where = keys[order], where[order]
            at = np.searchsorted(self.keys, distinct)
        return self.where[at][inverse]

    def stream(self, places: np.ndarray) -> np.ndarray:
        """The values of the chunks, one after the other."""
        return self.values[ragged(self.firsts[places], self.lengths[places])]
