"""Words of whole text columns as numpy arrays: bytes, spans, 64-bit hashes and shingles.

An Arrow string column is one byte buffer with offsets, so all words of a batch are found and hashed by a few passes
over that buffer instead of one Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text of one pass; the arrays of a pass take about 40 times as much memory.
PASS_BYTES = 2_000_000

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: The separators of `[^\x20\x09-\x0D]+`.
BLANK = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: ASCII letters and digits, and all bytes of other characters, make words.
NO_WORD = ~((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122)))

_MULTIPLIER = 0x9E3779B97F4A7C15
_M = np.uint64(_MULTIPLIER)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Values whose bits are spread over all 64 (an invertible map)."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v = v * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        steps = np.full(n + 1, _M, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
        _inverses = np.cumprod(steps, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with about ``most`` bytes of text each."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of its first word (one more entry at the end)."""
    apart = separators[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:], last[:-1] = apart[:-1], apart[1:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(first & ~apart)
    ends = np.flatnonzero(last & ~apart) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def words(column: pa.Array, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words of the column, and for each row the number of its first word."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = spans(data, offsets, separators)
    return span_hashes(data, starts, ends), rows


def sequences(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` hashes; entry i starts at hash i."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count] + np.uint64(size)
    for i in range(1, size):
        out = out * _M + hashes[i : i + count]
    return mixed(out)


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; fewer words than ``size`` make one shingle, none make none."""
    full = sequences(hashes, size)
    sets = []
    for begin, end in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        n = end - begin
        if n >= size:
            sets.append(np.unique(full[begin : end - size + 1]))
        else:
            sets.append(sequences(hashes[begin:end], n) if n else np.zeros(0, np.uint64))
    return sets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of every (start, length), one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    shifts = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else np.zeros(0, np.int64)
    return shifts + np.arange(total)
