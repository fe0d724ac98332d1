"""Language-model scores with a backoff automaton over smoothed bigrams.

Model. With c the training counts, N all tokens, V different ones: p(w) = (c(w) + 1) / (N + V + 1), and for a context h
p(w | h) = (c(hw) + m(h) p(w)) / (c(h) + m(h)) with m(h) = a + b sqrt(c(h)), Witten-Bell smoothing whose number of
different continuations follows Heaps' law. As an automaton: a state for each known context and a root; an arc for each seen
bigram, weighing log10 p(w | h); where a state has no arc for a token, its failure arc leads to the root and weighs
log10(m(h) / (c(h) + m(h))).

Scale. The model grows with the corpus and is never whole in one place. Documents form blocks; each block asks for
its own words and bigrams, packed by slices of the hash range, and hands in its own training counts with them. A slice
adds up the counts of all blocks and answers each, words with the slice's share of N and V. A block then builds the part of the automaton that its texts touch
and traverses each text once from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.samples import remainder
from groundline.llm.segments import mixed, passes, words
from groundline.llm.storage import partitions

BLOCK_TOKENS = 1_000_000
# 56 bits of a hash name a word or a bigram.
KEY_SHIFT = np.uint64(8)
BEGIN, END = mixed(np.array([1 << 62, 1 << 61], np.uint64)) >> KEY_SHIFT
A, B = 3.0, 15.0


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are empty and cost nothing."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return _pack(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(whole: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(whole):
        size = int.from_bytes(whole[at : at + 8], "little")
        parts.append(whole[at + 8 : at + 8 + size])
        at += 8 + size
    return parts


def bigram_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + token) >> KEY_SHIFT


def contexts(tokens: np.ndarray, starts: np.ndarray, begin) -> np.ndarray:
    """The token before each token; ``begin`` before the first of a document."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = begin
    return before


ROWS = "route long, kind int, block long, packed binary"
WORDS, BIGRAMS, DOCS = range(3)


def _rows(route, kind, block, packed) -> pa.RecordBatch:
    n = len(packed)
    full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), n))
    return pa.RecordBatch.from_arrays([full(route, np.int64), full(kind, np.int32), full(block, np.int64), pa.array(packed, pa.binary())], names=["route", "kind", "block", "packed"])


def _blocks(docs: DataFrame, slices: int) -> DataFrame:
    """Blocks of documents as packed rows, and each block's requests with its training counts, by slice."""

    def ask(kind: int, block: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        step = np.uint64((1 << 56) // slices + 1)
        bounds = np.searchsorted(keys, np.arange(slices + 1, dtype=np.uint64) * step)
        full = np.flatnonzero(np.diff(bounds)) if kind == BIGRAMS else np.arange(slices)  # every slice tells every block its totals
        packed = [joined([pack_sorted(keys[a:b]), pack_counts(counts[a:b])]) for a, b in zip(bounds[full].tolist(), bounds[full + 1].tolist(), strict=True)]
        return _rows(full, kind, block, packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            block = (part << 24) + number
            tokens, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            train = np.repeat(~np.concatenate([h[3] for h in held]), lengths)
            distinct, codes = np.unique(tokens, return_inverse=True)
            yield ask(WORDS, block, distinct, np.bincount(codes[train], minlength=len(distinct)))
            pairs, inverse = np.unique(bigram_keys(contexts(tokens, np.cumsum(lengths) - lengths, BEGIN), tokens), return_inverse=True)
            yield ask(BIGRAMS, block, pairs, np.bincount(inverse[train], minlength=len(pairs)))
            ids = [i for h in held for i in h[2]]
            head = [np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], np.uint8), lengths.astype("<i8"), np.concatenate([h[3] for h in held]).astype(np.uint8)]
            yield _rows(block, DOCS, block, [joined([*(h.tobytes() for h in head), pack_sorted(distinct), pack_counts(codes)])])
            held, size, number = [], 0, number + 1

        for batch in passes(batches):
            hashes, rows = words(batch.column("text"))
            lengths = np.diff(rows) + 1
            ends = np.cumsum(lengths) - 1
            tokens = np.full(len(hashes) + len(lengths), END)
            inside = np.ones(len(tokens), bool)
            inside[ends] = False
            tokens[inside] = hashes >> KEY_SHIFT
            if size and size + len(tokens) > BLOCK_TOKENS:
                yield from flush()
            held.append((tokens, lengths, batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False)))
            size += len(tokens)
        if held:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def _answers(rows: DataFrame, slices: int) -> DataFrame:
    """The counts over all blocks for each request, with the slice's totals for words, and the blocks' documents as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []

        def finish(kind: int, route: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            keys, counts = zip(*(parted(p) for _, p in asked), strict=True)
            keys = [unpack_sorted(k) for k in keys]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([unpack_counts(c) for c in counts]), len(distinct)).astype(np.int64)
            ends = np.cumsum([len(k) for k in keys])
            totals = [np.array([sums.sum(), (sums > 0).sum()], "<i8").tobytes()] * (kind == WORDS)
            yield _rows(route, kind, [b for b, _ in asked], [joined([pack_counts(sums[inverse[e - len(k) : e]]), *totals]) for e, k in zip(ends.tolist(), keys, strict=True)])

        for batch in batches:
            for route, kind, block, packed in zip(*(batch.column(c).to_pylist() for c in ("route", "kind", "block", "packed")), strict=True):
                if now and now != (kind, route):
                    yield from finish(*now, asked)
                    now, asked = None, []
                if kind == DOCS:
                    yield _rows(route, DOCS, block, [packed])
                else:
                    now = (kind, route)
                    asked.append((block, packed))
        if now:
            yield from finish(*now, asked)

    dealt = rows.repartition(slices, "kind", "route").sortWithinPartitions("kind", "route", "block")
    return dealt.mapInArrow(run, ROWS)


class BackoffAutomaton:
    """States: 0 the root, 1 the begin of a text, 2 + w after the known word w. All weights are log10."""

    def __init__(self, counts: np.ndarray, ends: int, pairs: np.ndarray, pair_counts: np.ndarray, total: int, different: int, a: float = A, b: float = B):
        """``counts`` of the words, ``ends`` of training texts, ``pairs``: state * words + word, sorted, of seen bigrams."""
        p = (counts + 1) / (total + different + 1)
        self.size, self.root_arcs = len(counts), np.log10(p)
        context = np.concatenate(([0.0, ends], counts.astype(float)))
        spread = a + b * np.sqrt(context)
        self.failure = np.log10(spread / (context + spread))
        self.failure[0] = 0.0
        self.pairs = pairs
        state, word = pairs // self.size, pairs % self.size
        self.arcs = np.log10((pair_counts + spread[state] * p[word]) / (context[state] + spread[state]))
        self.known = counts > 0

    def traverse(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each text: one pass from left to right, all texts in step, longest first."""
        order = np.argsort(-lengths, kind="stable")
        starts, sorted_lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        state, sums = np.ones(len(lengths), np.int64), np.zeros(len(lengths))
        left = np.searchsorted(-sorted_lengths, -np.arange(1, int(sorted_lengths[0]) + 1), "right") if len(lengths) else []
        for step, n in enumerate(left):
            word, at = tokens[starts[:n] + step], state[:n]
            weight = self.root_arcs[word]
            if len(self.pairs):
                wanted = at * self.size + word
                place = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
                found = (self.pairs[place] == wanted) & (at > 0)
                sums[:n] += np.where(found, self.arcs[place], self.failure[at] + weight)
            else:
                sums[:n] += self.failure[at] + weight
            state[:n] = np.where(self.known[word], word + 2, 0)
        out = np.empty(len(lengths))
        out[order] = sums
        return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``.

    The model learns from the rows whose crc32(doc_id) mod 7 is not 2; the others are held out. Tokens are the words of
    the whole text, A-Z lower-cased, then one end. Null texts are empty (one token), a null ``doc_id`` is in training, repeated
    rows count and are scored each, other columns are ignored, an empty table gives an empty result.
    """
    slices = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), remainder("doc_id", 7, 2).alias("held_out"))
    answers = _answers(_blocks(rows, slices), slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}

        def finish(parts: dict[int, list[bytes]]) -> pa.RecordBatch:
            ids, nulls, lengths, held, distinct, codes = parted(parts[DOCS][0])
            lengths, codes, distinct = np.frombuffer(lengths, "<i8"), unpack_counts(codes), unpack_sorted(distinct)
            answered = [[parted(p) for p in parts[k]] for k in (WORDS, BIGRAMS)]
            counts, pair_counts = (np.concatenate([unpack_counts(p[0]) for p in own]) for own in answered)
            total, different = (int(x) for x in np.sum([np.frombuffer(p[1], "<i8") for p in answered[0]], axis=0))
            starts = np.cumsum(lengths) - lengths
            before = contexts(distinct[codes], starts, BEGIN)
            _, first = np.unique(bigram_keys(before, distinct[codes]), return_index=True)
            state = contexts(codes, starts, -1)[first] + 2
            state[state == 1] = 1  # the begin of a text
            seen = pair_counts > 0
            pairs = state[seen] * len(distinct) + codes[first][seen]
            order = np.argsort(pairs)
            ends = int(counts[np.searchsorted(distinct, END)])
            model = BackoffAutomaton(counts, ends, pairs[order], pair_counts[seen][order], total, different)
            known = np.add.reduceat((counts[codes] > 0).astype(np.int64), starts)
            base = np.add.reduceat(model.root_arcs[codes], starts)
            nulls = np.frombuffer(nulls, np.uint8).astype(bool)
            return pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(ids, "<i8"), mask=nulls), pa.array(np.frombuffer(held, np.uint8).astype(bool)), pa.array(lengths), pa.array(known),
                pa.array(np.full(len(lengths), total, np.int64)), pa.array(base), pa.array(model.traverse(codes, lengths)),
            ], names=[c.split()[0] for c in SCORES.split(", ")])

        for batch in batches:
            for kind, block, packed in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "packed")), strict=True):
                if block != now and parts:
                    yield finish(parts)
                    parts = {}
                now = block
                parts.setdefault(kind, []).append(packed)
        if parts:
            yield finish(parts)

    dealt = answers.repartition(slices, "block").sortWithinPartitions("block", "kind", "route")
    return dealt.mapInArrow(run, SCORES)
