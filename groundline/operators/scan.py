"""Text ranking of few questions by one scan: their terms travel to the chunks, and every task keeps its own best chunks.

Scores of all pairs of questions and chunks exist only inside a batch, so what is shuffled is a bounded number of rows for
each task and list. Callers check the size of the questions first; more questions join by shuffle (``ranking.score_terms``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from groundline.functions.text import LOWER_FOLDS, analysed_text, issuer_key
from groundline.operators import index as X
from groundline.operators import ranking as R
from groundline.session import broadcast_if_small, has_copies, stored

# Query shares and cells of scores that are held at a time.
CELLS = 2_000_000
MATCHED = "field int, child_id string, issuer_key string, dl long, ids array<int>, tfs array<int>"
PARTS = "child_id string, issuer_key string, parts array<struct<field:int,size:double,ids:array<int>,tfs:array<int>>>"
WEIGHED = MATCHED.replace("field int, ", "").replace("dl long, ", "") + ", known double, rare double"
SLACK = 1e-6
# Every ASCII byte that is no letter or digit as a blank.
BLANKED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BEST = "list int, child_id string, issuer_key string, score double"


@dataclass
class Asked:
    """Query terms on the driver: the shares of term number ``i`` are those at ``starts[i]`` to ``starts[i + 1]``."""

    keys: list[tuple]
    filters: list[str | None]
    terms: list[str]
    starts: np.ndarray
    lists: np.ndarray
    weights: np.ndarray
    required: np.ndarray
    needed: np.ndarray

    @classmethod
    def of(cls, query_terms: DataFrame, by: list[str]) -> "Asked":
        marked = "required" in query_terms.columns
        rows = query_terms.select(*by, "issuer_filter", "term", F.col("query_weight").cast("double"), *(["required"] if marked else [])).where("term IS NOT NULL").collect()
        keys, terms = {}, {}
        for r in rows:
            keys.setdefault(tuple(r[: len(by) + 1]), len(keys))
            terms.setdefault(r["term"], len(terms))
        at = np.array([terms[r["term"]] for r in rows], "int64")
        order = np.argsort(at, kind="stable")
        must = np.array([bool(marked and r["required"]) for r in rows], bool)
        wanted: dict[tuple, set] = {}
        for r, m in zip(rows, must):
            wanted.setdefault(tuple(r[: len(by)]), set()).update([r["term"]] if m else [])
        return cls(
            list(keys), [k[-1] for k in keys], list(terms), np.searchsorted(at[order], np.arange(len(terms) + 1)),
            np.array([keys[tuple(r[: len(by) + 1])] for r in rows], "int64")[order],
            np.array([r["query_weight"] for r in rows], "float64")[order], must[order],
            np.array([len(wanted[k[:-1]]) for k in keys], "int64"))


def _folded(ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and UTF-8 bytes of texts after ``LOWER_FOLDS``, each of which makes one byte of two."""
    table = np.zeros(256, "uint8")
    for accented, plain in LOWER_FOLDS:
        table[accented.encode()[1]] = ord(plain)
    # all of them begin with this byte
    at = np.flatnonzero(values == LOWER_FOLDS[0][0].encode()[0])
    to = table[values[at + 1]]
    at, to = at[to > 0], to[to > 0]
    kept = np.ones(len(values), bool)
    kept[at + 1] = False
    values = values.copy()
    values[at] = to
    return ends - np.searchsorted(at, ends), values[kept]


def _cut(texts: pa.Array) -> pa.ListArray:
    """The analysed terms of :func:`text.analysed_text`."""
    if not len(texts):
        return pa.array([], pa.list_(texts.type))
    wide = pa.types.is_large_string(texts.type)
    valid, ends, values = texts.buffers()
    ends = np.frombuffer(ends, "int64" if wide else "int32")[texts.offset : texts.offset + len(texts) + 1]
    ends, values = _folded(ends, np.frombuffer(values or b"", "uint8")[: ends[-1]])
    blanked = pa.py_buffer(values.tobytes().translate(BLANKED))
    pieces = pc.ascii_split_whitespace(pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(ends.astype("int64" if wide else "int32")), blanked]))
    # a blank at either end leaves an empty piece
    full = pc.not_equal(pc.binary_length(pieces.values), 0)
    kept = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[pieces.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pieces.values.filter(full), mask=texts.is_null())


def _numbered(tokens: pa.ListArray, tf: np.ndarray | None, terms: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
    """Of each row's tokens the wanted terms by number, and their counts."""
    rows, n = len(tokens), max(1, len(terms))
    owner = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    flat = tokens.flatten()
    ids = pc.fill_null(pc.index_in(flat, value_set=terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
    held = ids >= 0
    cells = owner[held] * n + ids[held]
    if tf is None:
        cells, counts = np.unique(cells, return_counts=True)
    else:
        cells, inverse = np.unique(cells, return_inverse=True)
        counts = np.bincount(inverse, tf[held], len(cells))
    offsets = pa.array(np.searchsorted(cells, np.arange(rows + 1) * n).astype("int32"))
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(v.astype("int32"))) for v in (cells % n, counts))


def matched_parts(chunks: DataFrame, terms: list[str], indicator: bool = False) -> DataFrame:
    """(child_id, issuer_key, parts): of each field of a chunk (``ranking.content_fields``, by number) its length and the wanted
    terms by number, in the chunk's row. Texts travel whole and are cut where they are counted."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        for b in batches:
            found = [_cut(b.column("text")), *([b.column("named")] if indicator else [])]
            width = len(found)
            lists = [_numbered(tokens, None, wanted) for tokens in found]
            # the fields of a chunk follow each other
            order = pa.array(np.arange(b.num_rows * width).reshape(width, -1).T.reshape(-1))
            field = pa.array(np.tile(np.arange(width, dtype="int32"), b.num_rows))
            size = pa.concat_arrays([pc.list_value_length(tokens).cast(pa.float64()) for tokens in found]).take(order)
            ids, tfs = [pa.concat_arrays([pair[i] for pair in lists]).take(order) for i in (0, 1)]
            made = pa.StructArray.from_arrays([field, size, ids, tfs], ["field", "size", "ids", "tfs"])
            offsets = pa.array(np.arange(b.num_rows + 1, dtype="int32") * width)
            yield pa.RecordBatch.from_arrays([b.column("child_id"), b.column("issuer_key"), pa.ListArray.from_arrays(offsets, made)],
                                             ["child_id", "issuer_key", "parts"])

    named = [R.indicator_terms(F.col("indicator")).alias("named")] if indicator else []
    return chunks.select("child_id", issuer_key(F.col("issuer")).alias("issuer_key"), analysed_text(F.col("content")).alias("text"), *named).mapInArrow(match, PARTS)


def weighed_terms(packed: DataFrame, terms: list[str], known: dict[str, float]) -> DataFrame:
    """(child_id, issuer_key, ids, tfs, known, rare) of :func:`index.packed_counts`: the wanted terms by number, the sum of squared
    weights of the ``known`` terms and the sum of squared counts of all others."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, names = pa.array(terms, pa.string()), pa.array(list(known), pa.string())
        squares = np.append(np.array(list(known.values()), "float64") ** 2, 0.0)
        for b in batches:
            tokens = b.column("terms")
            flat, tf = tokens.flatten(), b.column("tfs").flatten().to_numpy(zero_copy_only=False).astype("float64")
            owner = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            at = pc.fill_null(pc.index_in(flat, value_set=names.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
            sums = [np.bincount(owner, v, b.num_rows) for v in (tf * tf * squares[at], tf * tf * (at < 0))]
            yield pa.RecordBatch.from_arrays(
                [b.column("child_id"), b.column("issuer_key"), *_numbered(tokens, tf, wanted), *[pa.array(v) for v in sums]],
                ["child_id", "issuer_key", "ids", "tfs", "known", "rare"])

    return packed.select("child_id", "issuer_key", F.col("entries.term").alias("terms"), F.col("entries.tf").alias("tfs")).mapInArrow(match, WEIGHED)


def matched_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(field, child_id, issuer_key, dl, ids, tfs): of rows(field, child_id, issuer_key, dl, terms[, tfs]) the wanted terms by number."""
    weighed = "tfs" in rows.columns

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        for b in batches:
            tf = b.column("tfs").flatten().to_numpy(zero_copy_only=False) if weighed else None
            lists = _numbered(b.column("terms"), tf, wanted)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("field", "child_id", "issuer_key", "dl")], *lists],
                                             ["field", "child_id", "issuer_key", "dl", "ids", "tfs"])

    return rows.select("field", "child_id", "issuer_key", "dl", "terms", *(["tfs"] if weighed else [])).mapInArrow(match, MATCHED)


class _BestTexts:
    """Running best ``k`` chunks of every list over the batches of one task."""

    def __init__(self, asked: Asked, share: Callable, k: int, filtered: bool):
        self.asked, self.share, self.k, self.filtered = asked, share, k, filtered
        self.least = np.zeros(len(asked.keys))
        self.best = pd.DataFrame({"list": np.array([], "int64"), "score": [], "child_id": np.array([], object), "issuer_key": np.array([], object)})
        self.found: list[pd.DataFrame] = []
        self.allowed: dict = {}

    def _allows(self, key: str | None) -> np.ndarray:
        """The lists whose filter lets this issuer pass, as ``text.keys_match``."""
        if key not in self.allowed:
            self.allowed[key] = np.array([not f or key is not None and (f in key or key in f) for f in self.asked.filters], bool)
        return self.allowed[key]

    def add(self, batch: pa.RecordBatch) -> None:
        parts = batch.column("parts")
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        flat = parts.flatten()
        ids = flat.field("ids")
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        part = np.repeat(np.arange(len(flat)), sizes)
        ids, tfs = ids.flatten().to_numpy(zero_copy_only=False), flat.field("tfs").flatten().to_numpy(zero_copy_only=False)
        shares = self.share(flat.field("field").to_numpy(zero_copy_only=False)[part], ids, tfs.astype("float64"),
                            flat.field("size").to_numpy(zero_copy_only=False)[part])
        rows = owner[part]
        width = self.asked.starts[ids + 1] - self.asked.starts[ids]
        cost = np.bincount(rows, width, batch.num_rows) + len(self.asked.keys)
        piece = (np.cumsum(cost) // CELLS).astype("int64")
        names, issuers = batch.column("child_id"), batch.column("issuer_key")
        for p in np.unique(piece):
            low, high = np.searchsorted(piece, p), np.searchsorted(piece, p, "right")
            at = slice(np.searchsorted(rows, low), np.searchsorted(rows, high))
            some = issuers.slice(low, high - low)
            self._take(low, self._scores(rows[at] - low, ids[at], shares[at], width[at], high - low, some), names.slice(low, high - low), some)

    def _scores(self, rows, ids, shares, width, n, issuers) -> np.ndarray:
        a, m = self.asked, len(self.asked.keys)
        ends = np.cumsum(width)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a.starts[ids] - (ends - width), width)
        cell = np.repeat(rows, width) * m + a.lists[at]
        scores = np.bincount(cell, a.weights[at] * np.repeat(shares, width), n * m).reshape(n, m)
        if a.needed.any():
            term, must = np.repeat(ids, width), a.required[at]
            once = np.unique(np.stack([cell[must], term[must]]), axis=1)[0]
            scores = np.where(np.bincount(once, minlength=n * m).reshape(n, m) == a.needed, scores, 0.0)
        if self.filtered and any(a.filters):
            codes = issuers.dictionary_encode()
            table = np.stack([self._allows(k) for k in [*codes.dictionary.to_pylist(), None]])
            scores = np.where(table[pc.fill_null(codes.indices, len(table) - 1).to_numpy(zero_copy_only=False)], scores, 0.0)
        return scores

    def _take(self, low, scores, names, issuers) -> None:
        # rounding moves a score by half a unit of the last digit
        row, lst = np.nonzero((scores > 0) & (scores >= self.least - 10.0 ** -R.SCORE_DIGITS))
        if not len(row):
            return
        self.found.append(pd.DataFrame({
            "list": lst, "score": np.round(scores[row, lst], R.SCORE_DIGITS), "child_id": names.take(pa.array(row)).to_numpy(zero_copy_only=False).astype(object),
            "issuer_key": issuers.take(pa.array(row)).to_numpy(zero_copy_only=False).astype(object)}))
        # a merge costs as much as all that is held, so it waits for as many new rows
        if sum(map(len, self.found)) >= len(self.best):
            self._merge()

    def _merge(self) -> None:
        both, self.found = pd.concat([self.best, *self.found], ignore_index=True), []
        lst, score = both["list"].to_numpy("int64"), both["score"].to_numpy("float64")
        order = np.lexsort((-score, lst))
        starts = np.searchsorted(lst[order], np.arange(len(self.least) + 1))
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.least[full] = score[order[starts[full] + self.k - 1]]
        both = both[score >= self.least[lst]]
        # names only decide where the last score of a list is shared
        crowded = (np.bincount(both["list"].to_numpy("int64"), minlength=len(self.least)) > self.k)[both["list"].to_numpy("int64")]
        tied = both[crowded].sort_values(["list", "score", "child_id"], ascending=[True, False, True], na_position="first", kind="stable")
        self.best = pd.concat([both[~crowded], tied.groupby("list", sort=False).head(self.k)], ignore_index=True)

    def result(self) -> pa.RecordBatch:
        if self.found:
            self._merge()
        b = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(b["list"].to_numpy(), pa.int32()), pa.array(list(b["child_id"]), pa.string()), pa.array(list(b["issuer_key"]), pa.string()),
             pa.array(b["score"].to_numpy(), pa.float64())], ["list", "child_id", "issuer_key", "score"])


class _Hopeful(_BestTexts):
    """The chunks of a batch that may reach a list's ``floor``."""

    def __init__(self, asked: Asked, share: Callable, floor: np.ndarray, filtered: bool):
        super().__init__(asked, share, 0, filtered)
        self.floor = floor

    def chosen(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        self.keep = np.zeros(batch.num_rows, bool)
        self.add(batch)
        return batch.filter(pa.array(self.keep))

    def _take(self, low, scores, names, issuers) -> None:
        self.keep[low : low + len(scores)] = ((scores > 0) & (scores >= self.floor - SLACK)).any(axis=1)


def _best(parts: DataFrame, query_terms: DataFrame, by: list[str], asked: Asked, share: Callable, k: int, filtered: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _BestTexts(asked, share, k, filtered)
        for batch in batches:
            best.add(batch)
        yield best.result()

    found = parts.select("child_id", "issuer_key", "parts").mapInArrow(scan, BEST)
    schema = query_terms.select(*by, "issuer_filter").schema
    names = query_terms.sparkSession.createDataFrame([(*key, i) for i, key in enumerate(asked.keys)], schema.add("list", IntegerType()))
    return found.join(F.broadcast(names), "list").select(*by, "issuer_filter", "child_id", "issuer_key", "score")


def _units(matched: DataFrame, size: str, alone: bool) -> DataFrame:
    """(child_id, issuer_key, parts): what belongs to a chunk in one row."""
    part = F.struct("field", F.col(size).cast("double").alias("size"), "ids", "tfs")
    if alone:
        return matched.select("child_id", "issuer_key", F.array(part).alias("parts"))
    return matched.groupBy("child_id", "issuer_key").agg(F.collect_list(part).alias("parts"))


def best_bm25(query_terms: DataFrame, chunks: DataFrame, by: list[str], k: int, indicator: bool = False) -> DataFrame:
    """The rows of :func:`ranking.bm25_scores` that can be among a list's best ``k``: at most ``k`` of each task and list."""
    asked = Asked.of(query_terms, by)
    units = matched_parts(chunks, asked.terms, indicator)
    if has_copies(chunks, "child_id"):
        rows = units.select("child_id", "issuer_key", F.explode("parts").alias("p")).select(
            "p.field", "child_id", "issuer_key", F.col("p.size").cast("long").alias("dl"), "p.ids", "p.tfs")
        matched = stored(_merged(rows.where("dl >= 0")), "bm25-matched")
        units = _units(matched.where(F.size("ids") > 0), "dl", False)
    else:
        units = stored(units, "bm25-matched")
        matched = units.select(F.explode("parts").alias("p")).select("p.field", F.col("p.size").alias("dl"), "p.ids").where("dl >= 0")
        units = units.where(F.exists("parts", lambda p: F.size(p["ids"]) > 0))
    width = 2 if indicator else 1
    lengths = matched.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("cf")).collect()
    df = np.zeros((width, max(1, len(asked.terms))))
    for r in matched.select("field", F.explode("ids").alias("id")).groupBy("field", "id").count().collect():  # the questions' terms
        df[r["field"], r["id"]] = r["count"]
    n, average = np.zeros((width, 1)), np.ones(width)
    for r in lengths:
        n[r["field"]], average[r["field"]] = r["n"], (r["cf"] / r["n"]) or 1.0
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    k1, b = X.BM25_K1, X.BM25_B

    def share(field, ids, tf, dl):
        return idf[field, ids] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average[field]))

    return _best(units, query_terms, by, asked, share, k, False)


def best_postings(query_terms: DataFrame, postings: DataFrame, by: list[str], k: int, filtered: bool) -> DataFrame:
    """The rows of :func:`ranking.score_terms` that can be among a list's best ``k``: at most ``k`` of each task and list.

    A chunk's postings of the wanted terms meet in one row, without an exchange where a store is bucketed by chunk; a pair of a
    posting and a list that asks for it is never a row. With ``filtered`` chunks have to pass their list's issuer filter.
    """
    asked = Asked.of(query_terms, by)
    numbers = query_terms.sparkSession.createDataFrame(list(zip(asked.terms, range(len(asked.terms)))), "term string, id int")
    held = postings.join(F.broadcast(numbers), "term").groupBy("child_id", "issuer_key").agg(F.collect_list(F.struct("id", "weight")).alias("e"))
    part = F.struct(F.lit(0).alias("field"), F.lit(0.0).alias("size"), F.col("e.id").alias("ids"), F.col("e.weight").alias("tfs"))
    units = held.select("child_id", "issuer_key", F.array(part).alias("parts"))
    return _best(units, query_terms, by, asked, lambda field, ids, weight, size: weight, k, filtered)


def _merged(matched: DataFrame) -> DataFrame:
    """Rows of one field, chunk and length as one."""
    key = ["field", "child_id", "issuer_key", "dl"]
    entries = F.explode_outer(F.arrays_zip("ids", "tfs")).alias("e")
    summed = matched.select(*key, entries).select(*key, "e.ids", "e.tfs").groupBy(*key, "ids").agg(F.sum("tfs").cast("int").alias("tf"))
    kept = F.filter(F.collect_list(F.struct("ids", "tf")), lambda e: e["ids"].isNotNull())
    return summed.groupBy(*key).agg(kept.alias("e")).select(*key, F.col("e.ids").alias("ids"), F.col("e.tf").alias("tfs"))


def best_tfidf(query_terms: DataFrame, packed: DataFrame, vocabulary: DataFrame, by: list[str], k: int) -> DataFrame:
    """The rows of :func:`ranking.score_terms` over unit-length chunk vectors that pass their list's issuer filter and can be among its best ``k``.

    ``packed`` are :func:`index.packed_counts` and ``vocabulary`` (term, df, idf) comes from them; both are read more than once.
    """
    asked = Asked.of(query_terms, by)
    idf = np.zeros(max(1, len(asked.terms)))
    number = {t: i for i, t in enumerate(asked.terms)}
    for r in vocabulary.join(F.broadcast(query_terms.select("term").distinct()), "term").select("term", "idf").collect():
        idf[number[r["term"]]] = r["idf"]
    def share(field, ids, tf, norm):
        return idf[ids] * tf / np.where(norm > 0, norm, 1.0)

    if has_copies(packed, "child_id"):
        rows = packed.select(F.lit(0).alias("field"), "child_id", "issuer_key", "dl", F.col("entries.term").alias("terms"), F.col("entries.tf").alias("tfs"))
        return _best(_units(_measured(matched_terms(rows, asked.terms).where(F.size("ids") > 0), packed, vocabulary), "norm", False),
                     query_terms, by, asked, share, k, True)
    matched = _hopeful(query_terms, packed, vocabulary, by, asked, share, k)
    ids = broadcast_if_small(matched.select(F.col("child_id").alias("__wanted")))
    own = packed.join(ids, F.col("child_id").eqNullSafe(F.col("__wanted")), "left_semi")
    return _best(_units(_measured(matched, own, vocabulary), "norm", True), query_terms, by, asked, share, k, True)


def _measured(matched: DataFrame, packed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``matched`` with the norms of their chunks."""
    norms = X.chunk_norms(X.unpacked(packed), vocabulary).select(F.col("child_id").alias("__child"), "norm")
    return matched.join(norms, F.col("child_id").eqNullSafe(F.col("__child")))


def _hopeful(query_terms: DataFrame, packed: DataFrame, vocabulary: DataFrame, by: list[str], asked: Asked, share: Callable, k: int) -> DataFrame:
    """(child_id, issuer_key, field, ids, tfs) of the chunks that can be among a list's best ``k``; nothing but the best is shuffled.

    Frequent terms (``index.HOT_TERMS`` at most) are weighed in the chunk's row; the rare ones bound its norm from both sides. The
    ``k``-th best score by the larger norm is a floor for the list, and only chunks whose score by the smaller norm reaches it need theirs.
    """
    hot, cold = X.hot_and_cold(vocabulary)
    known = {r["term"]: r["idf"] for r in hot.collect()}
    square = F.col("idf") * F.col("idf")
    least, most = cold.agg(F.coalesce(F.min(square), F.lit(0.0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    matched = stored(weighed_terms(packed, asked.terms, known).where(F.size("ids") > 0).select(
        "child_id", "issuer_key", F.lit(0).alias("field"), F.sqrt(F.col("known") + F.col("rare") * least).alias("low"),
        F.sqrt(F.col("known") + F.col("rare") * most).alias("high"), "ids", "tfs"), "tfidf-matched")
    sure = _best(_units(matched, "high", True), query_terms, by, asked, share, k, True)
    floor = np.zeros(len(asked.keys))
    number = {key: i for i, key in enumerate(asked.keys)}
    lists = [*by, "issuer_filter"]
    for r in R.top_k(sure, lists, R.best_first("score", "child_id"), k).where(F.col("rank") == k).select(*lists, "score").collect():
        floor[number[tuple(r[: len(lists)])]] = r["score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hopeful = _Hopeful(asked, share, floor, True)
        for batch in batches:
            yield hopeful.chosen(batch)

    chosen = _units(matched, "low", True).mapInArrow(scan, PARTS)
    part = F.get("parts", F.lit(0))
    return stored(chosen.select("child_id", "issuer_key", part["field"].alias("field"), part["ids"].alias("ids"), part["tfs"].alias("tfs")), "tfidf-hopeful")
