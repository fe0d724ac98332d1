"""Token ids of whole documents in wavelet-matrix files.

A shard file holds the ids of consecutive whole documents as one bit plane for each bit of an id, highest first. In
each plane the ids stand stably sorted by the bits above, so a prefix of the planes answers rank questions: the file
gives single tokens, counts and occurrences of an id without a decoded copy. Planes are zstd-compressed.

Layout (little endian): magic, documents, tokens, bits; then blocks, each with its byte length in front: document ids
(int64), null marks of the ids (1 byte each), token counts (uint32), and for each plane its zeros (uint64) and words.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundline.llm.chunks import ChunkMemory, chunk_starts
from groundline.llm.segments import passes, text_bytes
from groundline.llm.storage import partitions, shared_folder, stored

MAGIC = b"WMTOKEN1"
# Ids of one file; a longer document has a file of its own.
SHARD_TOKENS = 1 << 21


class WaveletMatrix:
    """Ids as bit planes with rank support."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.zeros = size, planes, zeros
        self.ahead = [np.concatenate(([0], np.cumsum(np.bitwise_count(p), dtype=np.int64))) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now, planes, zeros = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], []
        for level in range(bits - 1, -1, -1):
            ones = ((now >> level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(ids) // 64) * 8 + 8, np.uint8)
            padded[: len(packed)] = packed
            planes.append(padded.view("<u8"))
            low = now[~ones]
            zeros.append(len(low))
            now = np.concatenate([low, now[ones]])
        return cls(len(ids), planes, zeros)

    def ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a plane."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.planes[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ahead[level][word] + np.bitwise_count(below)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for level, zeros in enumerate(self.zeros):
            ones = self.ones_before(level, at)
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def _interval(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self.ones_before(level, np.array([start, end])).tolist()
            one = (token >> (len(self.planes) - 1 - level)) & 1
            start, end = (zeros + a, zeros + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id among the places from ``start`` to before ``end``."""
        a, b = self._interval(token, start, self.size if end is None else end)
        return b - a

    def locate(self, token: int) -> np.ndarray:
        """All places of an id in ascending order (select of each occurrence)."""
        start, end = self._interval(token, 0, self.size)
        at = np.arange(start, end)
        for level in range(len(self.planes) - 1, -1, -1):
            one = (token >> (len(self.planes) - 1 - level)) & 1
            at = self.select(level, at - self.zeros[level] if one else at, one)
        return np.sort(at)

    def select(self, level: int, nth: np.ndarray, one: int) -> np.ndarray:
        """Places of the given occurrences (from 0) of a bit in a plane."""
        ahead = self.ahead[level] if one else 64 * np.arange(len(self.ahead[level])) - self.ahead[level]
        word = np.searchsorted(ahead, nth, "right") - 1
        bits = self.planes[level][word] if one else ~self.planes[level][word]
        seen = np.cumsum((bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), axis=1)
        return word * 64 + (seen <= (nth - ahead[word])[:, None]).sum(axis=1)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane upwards."""
        out = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level].view(np.uint8), count=self.size, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[~ones] = out[: self.zeros[level]]
            above[ones] = out[self.zeros[level] :] | (1 << (len(self.planes) - 1 - level))
            out = above
        return out.astype(np.uint32)


def to_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    matrix, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    blocks = [
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), counts.astype("<u4").tobytes(),
        *(struct.pack("<Q", z) + pack.compress(p.tobytes()) for z, p in zip(matrix.zeros, matrix.planes, strict=True)),
    ]
    head = MAGIC + struct.pack("<QQI", len(doc_ids), len(ids), len(matrix.planes))
    return head + b"".join(struct.pack("<Q", len(b)) + b for b in blocks)


def from_file(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, token counts and the matrix of a shard file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, size, bits = struct.unpack_from("<QQI", content, 8)
    blocks, at = [], 28
    for _ in range(3 + bits):
        (length,) = struct.unpack_from("<Q", content, at)
        blocks.append(content[at + 8 : at + 8 + length])
        at += 8 + length
    nulls = np.frombuffer(blocks[1], np.uint8)
    doc_ids = [None if null else d for d, null in zip(np.frombuffer(blocks[0], "<i8").tolist(), nulls.tolist(), strict=True)]
    planes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b[8:]), "<u8") for b in blocks[3:]]
    assert len(doc_ids) == n_docs
    return doc_ids, np.frombuffer(blocks[2], "<u4"), WaveletMatrix(size, planes, [struct.unpack("<Q", b[:8])[0] for b in blocks[3:]])


class ByteLevelTokenizer:
    """A byte-level BPE file; ids of text columns as the tokenizers library gives them without added tokens.

    Texts are cut where the pre-tokenizer of this family always cuts: before a single blank between two other
    characters, around a single line end, and between ASCII letters, digits and other signs. Rows with one of the
    vocabulary's added tokens, or with blanks beyond space and line end, go to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        kind = json.loads(definition)
        before = kind.get("pre_tokenizer") or {}
        self.by_chunk = (
            kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and kind["model"]["type"] == "BPE"
        )
        whole = [re.escape(t["content"]) for t in kind.get("added_tokens", [])]
        whole.append(r"[\x09\x0B-\x0D\x1C-\x1F\x85\xA0  -     　]")
        self.whole = "|".join(whole)
        kinds = np.zeros(256, np.uint8)  # 0: never cut beside it
        for b in range(33, 127):
            kinds[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
        kinds[ord("'")] = 0
        a, b = np.meshgrid(kinds, kinds, indexing="ij")
        self.apart = (a != b) & (a > 0) & (b > 0)
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.memory = ChunkMemory(self._measure)

    def _measure(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks without blanks at risky places go to the library by the hundred, as lines of one text."""
        plain = np.array([b"\n" not in c and c[-1] != 32 and c[:2] != b"  " for c in chunks]) & (len(self.line) == 1)
        odd_counts, odd_ids = self._flat([c.decode() for c, p in zip(chunks, plain.tolist(), strict=True) if not p])
        lines = [c for c, p in zip(chunks, plain.tolist(), strict=True) if p]
        texts = [(b"\n".join(lines[i : i + 256]) + b"\n").decode() for i in range(0, len(lines), 256)]
        _, ids = self._flat(texts)
        ends = np.flatnonzero(ids == self.line[0]) if len(texts) else np.zeros(0, np.int64)
        counts = np.zeros(len(chunks), np.int64)
        counts[plain], counts[~plain] = np.diff(ends, prepend=-1) - 1, odd_counts
        owner = np.repeat(plain, counts)
        out = np.zeros(int(counts.sum()), np.int32)
        out[owner], out[~owner] = np.delete(ids, ends), odd_ids
        return counts, out

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, values = [], []
        for start in range(0, len(texts), 4096):
            for e in self.library.encode_batch_fast(texts[start : start + 4096], add_special_tokens=False):
                ids = e.ids
                counts.append(len(ids))
                values += ids
        return np.array(counts, np.int64), np.array(values, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each row, and all ids in turn; null is empty."""
        if not self.by_chunk:
            return self._flat([t or "" for t in column.to_pylist()])
        whole = pc.fill_null(pc.match_substring_regex(column, self.whole), False).to_numpy(zero_copy_only=False)
        if whole.all():
            return self._flat([t or "" for t in column.to_pylist()])
        counts, ids = self._by_chunk(column.filter(pa.array(~whole)))
        if not whole.any():
            return counts, ids
        own_counts, own_ids = self._flat(column.filter(pa.array(whole)).to_pylist())
        both = np.zeros(len(whole), np.int64)
        both[whole], both[~whole] = own_counts, counts
        owner = np.repeat(whole, both)
        out = np.zeros(int(both.sum()), np.int32)
        out[owner], out[~owner] = own_ids, ids
        return both, out

    def _by_chunk(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int32)
        cut = np.zeros(len(data), bool)
        cut[1:] = self.apart[data[:-1], data[1:]]
        plain = (data != 32) & (data != 10)
        plain_before, plain_after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        plain_before[1:], plain_after[:-1] = plain[:-1], plain[1:]
        full = offsets[1:] > offsets[:-1]
        plain_before[offsets[:-1][full]] = plain_after[offsets[1:][full] - 1] = False
        alone = ~plain & plain_before & plain_after
        cut |= alone
        cut[1:] |= alone[:-1] & (data[:-1] == 10)
        starts = chunk_starts(data, offsets, cut)
        places = self.memory.places(data, starts, np.append(starts[1:], len(data)))
        per_chunk = np.concatenate(([0], np.cumsum(self.memory.lengths[places])))
        bounds = per_chunk[np.searchsorted(starts, offsets)]
        return np.diff(bounds), self.memory.stream(places)


_tokenizers: dict[int, ByteLevelTokenizer] = {}


def _tokenizer(definition: str) -> ByteLevelTokenizer:
    """One for each worker process, so that later tasks know the chunks of earlier ones."""
    key = hash(definition)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = ByteLevelTokenizer(definition)
    return _tokenizers[key]


def put_file(folder: str, name: str, content: bytes, attempt: str) -> None:
    """Write a file whole: a task that runs again replaces it by the same content."""
    from pyarrow import fs

    place = re.sub(r"^file:/+", "/", folder)
    system, root = fs.FileSystem.from_uri(place if "://" in place else f"file://{place}")
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_{name}-{attempt}") as out:
        out.write(content)
    system.move(f"{root}/_{name}-{attempt}", f"{root}/{name}")


def write_token_files(docs: DataFrame, definition: str, folder: str, end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending ``doc_id`` order; return (part, shard, file, n_docs, n_tokens).

    ``definition`` is the tokenizer file's content. Null texts are empty, a null ``doc_id`` comes first, repeated ids
    stand side by side (by text), other columns are ignored; an empty table gives no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokenizer = TaskContext.get(), _tokenizer(shared.value)
        part, attempt, shard = task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}", 0
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, counts, ids, held, shard
            name = f"shard-{part:06d}-{shard:06d}.wm"
            put_file(folder, name, to_file(doc_ids, np.concatenate(counts), np.concatenate(ids)), attempt)
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "file": [name], "n_docs": [len(doc_ids)], "n_tokens": [held]})
            doc_ids, counts, ids, held, shard = [], [], [], 0, shard + 1
            return row

        for batch in passes(batches):
            n, values = tokenizer.encode(batch.column("text"))
            if end_id is not None:
                ends = np.cumsum(n + 1) - 1
                full = np.full(len(values) + len(n), end_id, np.int64)
                place = np.ones(len(full), bool)
                place[ends] = False
                full[place] = values
                n, values = n + 1, full
            if held and held + len(values) > shard_tokens:
                yield flush()
            doc_ids += batch.column("doc_id").to_pylist()
            counts.append(n)
            ids.append(values)
            held += len(values)
        if doc_ids:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    return stored(ordered.mapInArrow(write, "part long, shard long, file string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark, folder: str) -> DataFrame:
    """Per document of the files: (part, shard, seq, doc_id, first, n_tokens, ids_crc32), ``first`` within its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                part, shard = map(int, re.search(r"shard-(\d+)-(\d+)\.wm$", path.as_py()).groups())
                doc_ids, counts, matrix = from_file(content.as_py())
                ids = matrix.decode().astype("<u4")
                bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int32()),
                     pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1]), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["part", "shard", "seq", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    return files.mapInArrow(read, "part int, shard int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long")


def token_digest(spark, folder: str) -> DataFrame:
    """Per document of the files: (doc_id, start, n_tokens, ids_crc32); ``start`` counts the ids of all before it."""
    rows = stored(read_token_files(spark, folder), "token-digest")
    sums = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each partition of the writer
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    shards = sums.select("part", "shard", F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("inside")).join(ahead, "part")
    return rows.join(shards, ["part", "shard"]).select(
        "doc_id", (F.col("ahead") + F.col("inside") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, definition: str, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and return their digest, read back from them."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    if write_token_files(docs, definition, folder, end_id).isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return token_digest(spark, folder)
