"""BPE encoding by speculation: greedy longest matches are proposed, checked pair by pair, and only refuted words merged.

The BPE pieces of a word are the one sequence of tokens in which each token, and each two neighbours, would come out of
merging as they stand: a merge across a border would first of all show between its two neighbours. So a word's greedy
longest matches are its pieces when all adjacent pairs are compatible. Whether a pair is compatible follows from the last
symbols that the left token passes through while it grows, and the first ones of the right token: at the rank of every
merge that joins one of the former with one of the latter, one of the two must already have grown on. This is checked for
all pairs of a batch at once; a word with an incompatible pair is merged exactly, rank by rank.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.chunks import ChunkMemory
from groundline.llm.segments import passes, ragged, span_hashes, text_bytes

# The split pattern of this family of tokenizers, and its contractions.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

BLANK, LETTER, NUMBER, OTHER, UNSEEN = range(5)
#: Code points below this never compose with what stands before them.
PLAIN = 0x300
_FILTER_BITS = 20


def _byte_signs() -> list[str]:
    """The sign of each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    kept = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


@dataclass
class MergeTables:
    """A vocabulary as arrays, bounded by its size: built once on the driver and broadcast.

    ``left``, ``right`` and ``rank`` belong to a token's own merge (rank -1: a single symbol); ``pairs`` are the sorted
    keys left * size + right of all merges, ``made`` their tokens. ``middle`` and ``last`` are the symbols of a byte inside
    and at the end of a word. ``sound`` tokens come out of merging their own symbols.
    """

    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    middle: np.ndarray
    last: np.ndarray
    sound: np.ndarray
    spelt: list[bytes | None]
    ends: np.ndarray
    names: list[str]

    @classmethod
    def read(cls, kind: dict) -> MergeTables:
        model, suffix = kind["model"], kind["model"].get("end_of_word_suffix") or ""
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(vocab.values(), default=-1) + 1
        signs = _byte_signs()
        left, right, rank = (np.full(size, -1, np.int64) for _ in range(3))
        for at, (a, b) in enumerate(merges):
            made = vocab[a + b]
            if rank[made] >= 0 or max(rank[vocab[a]], rank[vocab[b]]) >= at:
                raise ValueError("a token with two merges, or a merge before its parts")
            left[made], right[made], rank[made] = vocab[a], vocab[b], at
        made = np.flatnonzero(rank >= 0)
        keys = left[made] * size + right[made]
        order = np.argsort(keys)
        byte_of = {s: b for b, s in enumerate(signs)}
        names, spelt, ends = [""] * size, [None] * size, np.zeros(size, bool)
        for token, i in vocab.items():
            names[i] = token
            ends[i] = bool(suffix) and token.endswith(suffix)
            body = token.removesuffix(suffix) if ends[i] else token
            if body and all(c in byte_of for c in body):
                spelt[i] = bytes(byte_of[c] for c in body)
        middle = np.array([vocab[s] for s in signs])
        last = np.array([vocab[s + suffix] for s in signs])
        tables = cls(left, right, rank, keys[order], made[order], middle, last, np.zeros(size, bool), spelt, ends, names)
        tables.sound[np.concatenate([middle, last])] = True
        whole = ~tables.crossed(left[made], right[made], rank[made])
        for i, ok in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda m: rank[m[0]]):
            tables.sound[i] = ok and tables.sound[left[i]] and tables.sound[right[i]]
        return tables

    def rank_of(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        keys = a * len(self.rank) + b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank[self.made[at]], none) if len(self.pairs) else np.full(len(a), none)

    def crossed(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the symbols of a + b joins some across the border (before rank ``below``, if given).

        Walks back through what stands beside the border: the later of the two merges is undone each time. Of equal
        ranks the left place merges first.
        """
        never = len(self.rank) + 1
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), bool)
        until_a = np.full(len(a), never) if below is None else below.copy()
        until_b = until_a - 1
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            joins = self.rank_of(x, y, never)
            hit = (joins < until_a[live]) & (joins <= until_b[live])
            out[live[hit]] = True
            live = live[~hit]
            x, y = a[live], b[live]
            undo_b = self.rank[y] >= self.rank[x]
            grown = np.maximum(self.rank[x], self.rank[y]) >= 0
            one, two = live[grown & ~undo_b], live[grown & undo_b]
            until_a[one], until_b[two] = self.rank[a[one]], self.rank[b[two]]
            a[one], b[two] = self.right[a[one]], self.left[b[two]]
            live = live[grown]
        return out

    def merged(self, symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
        """Exact merging: the lowest rank first, leftmost first among equals."""
        n = len(symbols)
        ids, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*merges[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, token, i, pair = heapq.heappop(heap)
            k = after[i]
            if k >= n or (ids[i], ids[k]) != pair:
                continue  # one of the two has been merged since
            ids[i], ids[k] = token, -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n and (p := (ids[at], ids[after[at]])) in merges:
                    heapq.heappush(heap, (*merges[p], at, p))
        return [i for i in ids if i >= 0]


class WordBpe:
    """A BPE file with word ends, applied as the tokenizers library does without truncation, padding or added specials."""

    def __init__(self, definition: str, tables: MergeTables | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        kind = json.loads(definition)
        _check(kind)
        self.library = Tokenizer.from_str(definition)
        self.tables = t = tables or MergeTables.read(kind)
        self.special = {a["content"]: a["id"] for a in kind.get("added_tokens", [])}
        self.cut = "(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")" if self.special else None
        size = max(len(t.names), *(i + 1 for i in self.special.values())) if self.special else len(t.names)
        self.names = t.names + [""] * (size - len(t.names))
        for text, i in self.special.items():
            self.names[i] = text
        self.merges = {(int(t.left[i]), int(t.right[i])): (int(t.rank[i]), int(i)) for i in t.made.tolist()}
        self.lower = np.array([self._lowered(c) for c in range(PLAIN)], np.uint32)
        self.kinds = np.full(0x110000, UNSEEN, np.int8)
        self.speller = _Speller(t)
        self.memory = ChunkMemory(self._measure)
        self.refuted = self.proposed = 0

    def _lowered(self, code: int) -> int:
        """What the normalizer makes of a code point; 0xFFFFFFFF if that isn't one code point."""
        out = self.library.normalizer.normalize_str(chr(code))
        return ord(out) if len(out) == 1 else 0xFFFFFFFF

    # --- texts to words --------------------------------------------------------------------------------------------

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.kinds[codes]
        new = np.unique(codes[found == UNSEEN])
        if len(new):
            for c in new.tolist():  # the library's own classes, asked once for each code point
                inside = [s for s, _ in self.library.pre_tokenizer.pre_tokenize_str("a" + chr(c) + chr(c) + "a")]
                self.kinds[c] = LETTER if len(inside) == 1 else NUMBER if len(inside) == 4 else OTHER if len(inside) == 3 else BLANK
            found = self.kinds[codes]
        return found

    def _normalized(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all normalized rows, and where the rows begin (one more entry at the end)."""
        data, offsets = text_bytes(column)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        plain = codes < PLAIN
        small = self.lower[np.where(plain, codes, 0)]
        odd = ~plain | (small == 0xFFFFFFFF)
        if not odd.any():
            return small, begins
        rows = np.unique(np.searchsorted(begins, np.flatnonzero(odd), "right") - 1)
        parts, sizes, done = [], np.diff(begins), 0
        for row in rows.tolist():
            text = codes[begins[row] : begins[row + 1]].tobytes().decode("utf-32-le")
            own = np.frombuffer(self.library.normalizer.normalize_str(text).encode("utf-32-le"), "<u4")
            parts += [small[begins[done] : begins[row]], own]
            sizes[row], done = len(own), row + 1
        return np.concatenate([*parts, small[begins[done] :]]), np.concatenate(([0], np.cumsum(sizes)))

    def _words(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end code point of each word."""
        n, kinds = len(codes), self._classes(codes)
        new = np.ones(n, bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        new[begins[:-1][begins[:-1] < n]] = True
        # a quotation mark that is a sign of its own, with what follows it in its row
        mark = np.flatnonzero((codes == ord("'")) & new)
        ends = begins[np.searchsorted(begins, mark, "right")]
        at = lambda shift: np.where(mark + shift < ends, codes[np.minimum(mark + shift, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in LONG_ENDINGS])
        size = np.where(long, 3, np.where(short, 2, 0))
        new[mark[size > 0] + 1] = False
        after = mark[size > 0] + size[size > 0]
        new[after[after < n]] = True
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], n)
        full = kinds[starts] != BLANK
        return starts[full], stops[full]

    # --- words to ids ----------------------------------------------------------------------------------------------

    def _measure(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        t = self.tables
        word, token = self.speller.proposals(chunks)
        beside = np.flatnonzero(word[1:] == word[:-1])
        key, inverse = np.unique(token[beside] * len(t.rank) + token[beside + 1], return_inverse=True)
        bad = t.crossed(key // len(t.rank), key % len(t.rank))[inverse]
        wrong = np.zeros(len(chunks), bool)
        wrong[word[beside[bad]]] = True
        self.proposed, self.refuted = self.proposed + len(chunks), self.refuted + int(wrong.sum())
        counts = np.bincount(word, minlength=len(chunks))
        kept, again = ~wrong[word], np.flatnonzero(wrong)
        exact = [t.merged([*t.middle[list(c[:-1])].tolist(), int(t.last[c[-1]])], self.merges) for c in (chunks[i] for i in again.tolist())]
        counts[again] = [len(x) for x in exact]
        out = np.zeros(int(counts.sum()), np.int32)
        owner = np.repeat(~wrong, counts)
        out[owner], out[~owner] = token[kept], [i for x in exact for i in x]
        return counts, out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each row, and all ids; null rows are empty."""
        column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
        owner, special = None, None
        if self.cut and len(column):
            marked = pc.match_substring_regex(column, self.cut).to_numpy(zero_copy_only=False)
            if marked.any():
                owner, special, pieces = [], [], []
                for row, (text, cut) in enumerate(zip(column.to_pylist(), marked.tolist(), strict=True)):
                    for piece in re.split(self.cut, text) if cut else [text]:
                        name = self.special.get(piece, -1) if cut else -1
                        owner.append(row)
                        special.append(name)
                        pieces.append("" if name >= 0 else piece)
                rows, column = len(column), pa.array(pieces, pa.string())
        counts, ids = self._plain(column)
        if owner is None:
            return counts, ids
        special = np.array(special)
        whole = counts + (special >= 0)
        out = np.zeros(int(whole.sum()), np.int32)
        own = np.repeat(special >= 0, whole)
        out[own], out[~own] = special[special >= 0], ids
        return np.bincount(owner, whole, rows).astype(np.int64), out

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, begins = self._normalized(column)
        if not len(codes):
            return np.zeros(len(column), np.int64), np.zeros(0, np.int32)
        first, past = self._words(codes, begins)
        data = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))
        places = self.memory.places(data, place[first], place[past])
        sums = np.concatenate(([0], np.cumsum(self.memory.lengths[places])))
        return np.diff(sums[np.searchsorted(first, begins)]), self.memory.stream(places)

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library's ``decode`` without skipping special tokens: this family joins tokens by a blank."""
        return " ".join(self.names[i] for i in ids)


class _Speller:
    """The greedy longest matches of words: at each place the longest sound token, one that ends words at a word's end only."""

    def __init__(self, tables: MergeTables):
        self.by_length: list[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]] = []
        ends_matter = bool(tables.ends.any())
        groups: dict[tuple[int, bool], list[int]] = {}
        for i in np.flatnonzero(tables.sound).tolist():
            if tables.spelt[i]:
                groups.setdefault((len(tables.spelt[i]), bool(tables.ends[i])), []).append(i)
        for (length, end), tokens in sorted(groups.items()):
            data = np.frombuffer(b"".join(tables.spelt[i] for i in tokens), np.uint8)
            starts = np.arange(len(tokens)) * length
            hashes = span_hashes(data, starts, starts + length)
            order = np.argsort(hashes)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length.append((length, end, hashes[order], np.array(tokens)[order], seen))
        self.ends_matter = ends_matter

    def proposals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of all greedy matches, word by word and from left to right."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes)
        stop = np.repeat(stops, sizes)
        token, reach = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        left = stop - np.arange(len(data))
        for length, end, hashes, tokens, seen in self.by_length:  # longer matches replace shorter ones
            at = np.flatnonzero(left == length if end else left > length if self.ends_matter else left >= length)
            found = span_hashes(data, at, at + length)
            maybe = seen[found >> np.uint64(64 - _FILTER_BITS)]
            at, found = at[maybe], found[maybe]
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            hit = hashes[place] == found
            token[at[hit]], reach[at[hit]] = tokens[place[hit]], length
        now, live, rounds = stops - sizes, np.flatnonzero(sizes > 0), []
        now = now[live]
        while len(live):
            rounds.append((live, token[now]))
            now = now + reach[now]
            on = now < stops[live]
            live, now = live[on], now[on]
        word, found = (np.concatenate(x) for x in zip(*rounds, strict=True)) if rounds else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        return word[order], found[order]


def _check(kind: dict) -> None:
    """Raise for files of another family: their words would be cut otherwise."""
    model, normal, before = kind["model"], kind.get("normalizer") or {}, kind.get("pre_tokenizer") or {}
    steps = [n.get("type") for n in normal.get("normalizers", [])]
    cuts = before.get("pretokenizers", [])
    fits = (
        model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": SPLIT} and cuts[0].get("invert") and cuts[0]["behavior"] == "Removed"
        and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex", True)
        and kind.get("post_processor") is None and kind.get("decoder") is None
        and all(a["special"] and not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in kind.get("added_tokens", []))
    )
    if not fits:
        raise ValueError("not a lower-casing byte-level BPE file with word ends")


_coders: dict[int, WordBpe] = {}


def _coder(shared) -> WordBpe:
    definition, tables = shared
    key = hash(definition)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordBpe(definition, tables)
    return _coders[key]


def _with_coder(docs: DataFrame, definition: str, schema: str, rows: Callable[[WordBpe, pa.RecordBatch], list[pa.Array]], text: str | None = None) -> DataFrame:
    """Row-by-row work of a coder; the vocabulary's tables (some MB, bounded by its size) go to all tasks."""
    kind = json.loads(definition)
    _check(kind)
    shared = docs.sparkSession.sparkContext.broadcast((definition, MergeTables.read(kind)))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, text) if text else batches:
            yield pa.RecordBatch.from_arrays(rows(_coder(shared.value), batch), names=names)

    return docs.mapInArrow(run, schema)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, definition: str) -> DataFrame:
    """(doc_id, ids) of ``docs(doc_id, text)``; ``definition`` is the content of a tokenizers file of this family.

    Null and empty texts have no ids, null and repeated ``doc_id`` stay as they are, other columns are ignored, an empty
    table gives an empty result. Strings of the file's special tokens become their ids. Row by row, no shuffle.
    """

    def rows(coder: WordBpe, batch: pa.RecordBatch) -> list[pa.Array]:
        counts, ids = coder.encode(batch.column("text"))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        return [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    return _with_coder(_narrow(docs), definition, "doc_id long, ids array<int>", rows, "text")


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``; null ids are an empty text, ids outside the vocabulary are left out."""

    def rows(coder: WordBpe, batch: pa.RecordBatch) -> list[pa.Array]:
        n = len(coder.names)
        texts = [coder.decode([i for i in ids or [] if i is not None and 0 <= i < n]) for ids in batch.column("ids").to_pylist()]
        return [batch.column("doc_id"), pa.array(texts, pa.string())]

    narrow = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return _with_coder(narrow, definition, "doc_id long, text string", rows)


def round_trip_digest(docs: DataFrame, definition: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of each text and of what they decode to.

    Rows are treated as in :func:`encode`; a text without ids has the digests of the empty string.
    """

    def rows(coder: WordBpe, batch: pa.RecordBatch) -> list[pa.Array]:
        counts, ids = coder.encode(batch.column("text"))
        ends = np.cumsum(counts)
        digests = []
        for written in (_Written(map(str, range(len(coder.names)))), _Written(coder.names)):
            raw, sizes = written.joined(ids)
            past = np.concatenate(([0], np.cumsum(sizes)))
            digests.append([sha256(raw[past[e - c] : max(past[e] - 1, past[e - c])]).hexdigest() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)])
        return [batch.column("doc_id"), pa.array(counts.astype(np.int64)), *[pa.array(d, pa.string()) for d in digests]]

    return _with_coder(_narrow(docs), definition, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, "text")


class _Written:
    """A string for each id, each followed by a blank."""

    def __init__(self, names):
        spelt = [n.encode() + b" " for n in names]
        self.sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(spelt), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        sizes = self.sizes[ids]
        return self.data[ragged(self.starts[ids], sizes)].tobytes(), sizes
