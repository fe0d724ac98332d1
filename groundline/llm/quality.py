"""Quality of documents by co-training two views.

One classifier sees the text's content, the other the page's metadata and layout. In each round each of them labels the
unlabelled documents that it is surest of for the other one's training set. Both are then calibrated on labelled documents
that neither was trained on, and a logistic combination of their log-odds scores all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.samples import labelled_sample, remainder
from groundline.llm.segments import BLANK, LOWER, passes, sequences, span_hashes, spans, text_bytes
from groundline.llm.storage import stored

BINS, LANG_BUCKETS, SOURCE_BUCKETS = 10, 16, 64
_B = np.arange(256)
#: Byte classes whose shares describe a text.
CLASSES = [
    (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57), _B >= 128, np.isin(_B, [ord(c) for c in "!?"]),
    np.isin(_B, [ord(c) for c in ".,;:"]), np.isin(_B, [ord(c) for c in "#$%&*@^~=+"]), np.isin(_B, [ord(c) for c in "|<>{}[]()/\\_"]), BLANK,
]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def text_view(column: pa.Array) -> np.ndarray:
    """Per row: shares of the byte classes, mean word length, shares of distinct words and of distinct word triples."""
    data, offsets = text_bytes(column)
    sizes = np.maximum(np.diff(offsets), 1)
    shares = [_per_row(c[data], offsets) / sizes for c in CLASSES]
    starts, ends, rows = spans(data, offsets, BLANK)
    hashes = span_hashes(LOWER[data], starts, ends)
    counts = np.diff(rows)
    triples = sequences(hashes, 3)
    distinct = [len(np.unique(hashes[a:b])) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    runs = [len(np.unique(triples[a : max(a, b - 2)])) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    length = np.diff(np.concatenate(([0], np.cumsum(ends - starts)))[rows]) / np.maximum(counts, 1)
    return np.column_stack([*shares, length, np.array(distinct) / np.maximum(counts, 1), np.array(runs) / np.maximum(counts - 2, 1)])


def page_view(batch: pa.RecordBatch) -> np.ndarray:
    """Per row: bucket of language and of source, size as stated and as found, lines, mean and largest line."""
    data, offsets = text_bytes(batch.column("text"))
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[1:], offsets[:1]]))
    longest = np.zeros(batch.num_rows)
    row = np.searchsorted(offsets, ends[:-1], "right") - 1
    np.maximum.at(longest, np.minimum(row, batch.num_rows - 1), np.diff(ends))
    lines = _per_row(data == 10, offsets) + 1
    sizes = np.diff(offsets)
    stated = pc.fill_null(batch.column("n_chars").cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    bucket = lambda name, n: np.array([zlib.crc32((v or "").encode()) % n for v in batch.column(name).to_pylist()], float)
    return np.column_stack([
        bucket("lang", LANG_BUCKETS), bucket("source", SOURCE_BUCKETS), np.log1p(np.maximum(stated, -0.5)), np.log1p(sizes), np.log1p(lines),
        np.log1p(sizes / lines), np.log1p(longest),
    ])


@dataclass
class View:
    """A logistic model over one-hot features: ``edges`` has the bin borders of a numeric column, or a number of buckets."""

    edges: list
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def cells(self, values: np.ndarray) -> np.ndarray:
        """Column of each feature that is set, one for each column of ``values``."""
        out, at = [], 0
        for edge, column in zip(self.edges, values.T, strict=True):
            if isinstance(edge, int):
                out.append(at + column.astype(np.int64))
                at += edge
            else:
                out.append(at + np.searchsorted(edge, column, "right"))
                at += len(edge) + 1
        return np.column_stack([*out, np.full(len(values), at)])

    @property
    def width(self) -> int:
        return sum(e if isinstance(e, int) else len(e) + 1 for e in self.edges) + 1

    def log_odds(self, values: np.ndarray) -> np.ndarray:
        """Calibrated."""
        return self.slope * self.weights[self.cells(values)].sum(axis=1) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Logistic regression with a ridge penalty."""
    theta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        gradient = x.T @ (weight * (y - p)) - ridge * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta))
        step = np.linalg.solve(hessian, gradient)
        theta += step
        if np.abs(step).max() < 1e-6:
            break
    return theta


@dataclass
class QualityModel:
    text: View
    page: View
    combination: np.ndarray

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(text), self.page.log_odds(page)
        w = self.combination
        return _sigmoid(a), _sigmoid(b), _sigmoid(w[0] + w[1] * a + w[2] * b)


def _calibrated(views: list[View], cells: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> QualityModel:
    """The views with slopes and shifts, and their combination, fitted on held-out rows."""
    pair = []
    for view, x in zip(views, cells, strict=True):
        raw = view.weights[x].sum(axis=1)
        view.shift, view.slope = _newton(np.column_stack([np.ones(len(raw)), raw]), y, w, 1e-3).tolist()
        pair.append(view.slope * raw + view.shift)
    return QualityModel(views[0], views[1], _newton(np.column_stack([np.ones(len(y)), *pair]), y, w, 1e-3))


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BUCKETS = [LANG_BUCKETS, SOURCE_BUCKETS]
# Steps of the log-odds in which documents are counted.
GRID = 1024
# Partial sums that are added in one task.
FAN_IN = 16


def _narrow(docs: DataFrame) -> DataFrame:
    kinds = ["long", "string", "string", "string", "double"]
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in zip(COLUMNS, kinds, strict=True)])


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, content, page) of every row: both views as packed 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            parts = [pa.array([r.tobytes() for r in view.astype(np.float32)], pa.binary()) for view in (text_view(batch.column("text")), page_view(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *parts], names=["doc_id", "content", "page"])

    return stored(_narrow(docs).mapInArrow(run, "doc_id long, content binary, page binary"), "quality-features")


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(b, np.float32) for b in column.to_pylist()], np.float64)


def _counted(df: DataFrame, counts) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, sorted values, sum of the weights of each) of the (values, weights) that ``counts`` makes of a batch, one for each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, (values, weights) in enumerate(counts(batch) if batch.num_rows else []):
                found, at = np.unique(values, return_inverse=True)
                n = np.bincount(at, weights, len(found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind)), pa.array(found.astype(float)), pa.array(n)], names=["kind", "value", "n"])

    sums = df.mapInArrow(run, "kind long, value double, n double").groupBy("kind", "value").agg(F.sum("n").alias("n")).toArrow().sort_by([("kind", "ascending"), ("value", "ascending")])
    kind, value, n = (sums[c].to_numpy() for c in ("kind", "value", "n"))
    return [(k, value[kind == k], n[kind == k]) for k in np.unique(kind).tolist()]


def _views(features: DataFrame) -> list[View]:
    """Views whose bins hold equal parts of all rows (borders to 11 bits)."""

    def counts(batch: pa.RecordBatch) -> list[tuple]:
        values = np.column_stack([_unpacked(batch.column("content")), _unpacked(batch.column("page"))[:, len(BUCKETS) :]])
        cut = (values.astype(np.float32).view(np.uint32) & np.uint32(0xFFFFF000)).view(np.float32)
        return [(column, np.ones(len(column))) for column in cut.T]

    edges = []
    for _, values, n in _counted(features, counts):
        ends = np.cumsum(n)
        edges.append(np.unique(values[np.searchsorted(ends, np.linspace(0, 1, BINS + 1)[1:-1] * ends[-1])]))
    content = len(CLASSES) + 3
    return [View(edges[:content], np.zeros(0)), View([*BUCKETS, *edges[content:]], np.zeros(0))]


@dataclass
class Given:
    """What a view was given by the other one in a round: rows whose odds under ``weights`` (in steps of the grid) are below
    ``low`` or above ``high``; rows on a border all give an equal part of their weight (``at_low``, ``at_high``)."""

    weights: np.ndarray
    low: float
    at_low: float
    high: float
    at_high: float


def _cells_of(batch: pa.RecordBatch, widths: tuple[int, int]) -> list[np.ndarray]:
    both = np.array([np.frombuffer(b, np.uint16) for b in batch.column("cells").to_pylist()], np.int64).reshape(batch.num_rows, sum(widths))
    return [both[:, : widths[0]], both[:, widths[0] :]]


def _grid(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.floor(weights[cells].sum(axis=1) * GRID + 0.5)


def _pseudo(cells: list[np.ndarray], given: list[list[Given]], view: int) -> tuple[np.ndarray, np.ndarray]:
    """Label (-1: none) and weight, 1 at most, that each row has in a view's training set after all rounds so far."""
    label, weight = np.full(len(cells[0]), -1), np.zeros(len(cells[0]))
    for g in given[view]:
        odds = _grid(cells[1 - view], g.weights)
        for value, hit, on in ((0, odds <= g.low, odds == g.low), (1, odds >= g.high, odds == g.high)):
            new = hit & (label != 1 - value)
            label[new] = value
            weight[new] += (1 - weight[new]) * np.where(on[new], (g.at_low, g.at_high)[value], 1.0)
    return label, weight


def _border(values: np.ndarray, n: np.ndarray, each: int) -> tuple[float, float]:
    """The value up to which the first ``each`` rows lie, and the share of the rows on it that are among them."""
    at = int(min(np.searchsorted(np.cumsum(n), each), len(n) - 1))
    return float(values[at]), min(1.0, (each - (np.cumsum(n)[at] - n[at])) / n[at])


def _handed_over(pool: DataFrame, widths: tuple[int, int], weights: list[np.ndarray], given: list[list[Given]], each: int) -> None:
    """One round: each view adds its surest ``each`` rows of each class, of all rows that the other one lacks, to ``given``."""

    def counts(batch: pa.RecordBatch) -> list[tuple]:
        cells, found = _cells_of(batch, widths), []
        for own in (0, 1):
            odds, (label, weight) = _grid(cells[own], weights[own]), _pseudo(cells, given, 1 - own)
            free = (weight < 1) & ((label < 0) | ((label == 1) == (odds > 0)))
            found.append((odds[free], 1 - weight[free]))
        return found

    for own, values, n in _counted(pool, counts):
        sure_low, sure_high = values < -GRID, values > GRID
        low = _border(values[sure_low], n[sure_low], each) if sure_low.any() else (-np.inf, 0.0)
        high = _border(values[sure_high][::-1], n[sure_high][::-1], each) if sure_high.any() else (np.inf, 0.0)
        given[1 - own].append(Given(weights[own], *low, *high))


def _sums(cells: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Gradient and, row by row, curvature of the weighted log-likelihood at ``theta``."""
    size = len(theta)
    p = _sigmoid(theta[cells].sum(axis=1))
    first = np.bincount(cells.ravel(), np.repeat(weight * (y - p), cells.shape[1]), size)
    second, bend = np.zeros(size * size), weight * p * (1 - p)
    for column in cells.T:
        second += np.bincount((column[:, None] * size + cells).ravel(), np.repeat(bend, cells.shape[1]), size * size)
    return np.concatenate([first, second])


PARTIAL = "part long, a binary, b binary"


def _added(key: tuple, sums: pa.Table) -> pa.Table:
    """One row of ``PARTIAL`` for all of a group, added in the order of their parts."""
    ordered = sums.sort_by("part")
    both = [sum(np.frombuffer(x) for x in ordered[c].to_pylist()).tobytes() for c in ("a", "b")]
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "a": pa.array([both[0]], pa.binary()), "b": pa.array([both[1]], pa.binary())})


def _merged(sums: DataFrame, parts: int) -> list:
    """At most ``FAN_IN`` rows whose sum is that of the ``parts`` rows of ``sums``, each some 250 KB; tasks add ``FAN_IN`` neighbours at
    a time, so neither a task nor the driver holds more, and always in the same order."""
    while parts > FAN_IN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(_added, PARTIAL)
        parts = -(-parts // FAN_IN)
    return sorted(sums.collect(), key=lambda row: row["part"])


def _fit(known: list[tuple], pool: DataFrame | None, widths: tuple[int, int], given: list[list[Given]], start: list[np.ndarray], steps: int = 12) -> list[np.ndarray]:
    """Logistic regression of both views, as ``_newton``, on ``known`` (cells, label, weight of each view) and on all rows of
    ``pool`` with pseudo-labels; a step sums over all of them on Spark."""
    theta = [t.copy() for t in start]
    for _ in range(steps):
        totals = [_sums(*rows, t) for rows, t in zip(known, theta, strict=True)]
        if pool is not None and any(given):

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums, at = [np.zeros(len(t) * (len(t) + 1)) for t in theta], TaskContext.get().partitionId()
                for batch in batches:
                    cells = _cells_of(batch, widths)
                    for view in (0, 1):
                        label, weight = _pseudo(cells, given, view)
                        on = label >= 0
                        sums[view] += _sums(cells[view][on], label[on], weight[on], theta[view])
                yield pa.RecordBatch.from_arrays([pa.array([at]), *[pa.array([x.tobytes()], pa.binary()) for x in sums]], names=["part", "a", "b"])

            for row in _merged(pool.mapInArrow(run, PARTIAL), pool.rdd.getNumPartitions()):
                totals = [t + np.frombuffer(x) for t, x in zip(totals, (row["a"], row["b"]), strict=True)]
        moved = []
        for t, total in zip(theta, totals, strict=True):
            size = len(t)
            step = np.linalg.solve(total[size:].reshape(size, size) + np.eye(size), total[:size] - t)
            t += step
            moved.append(np.abs(step).max())
        if max(moved) < 1e-6:
            break
    return theta


def fit_quality(features: DataFrame, labels: DataFrame, per_class: int = 4000, rounds: int = 5, share: float = 0.02) -> QualityModel | None:
    """Fit on up to ``per_class`` labelled documents of each class, taken in hash order of the id, and on all unlabelled rows.

    In each of the ``rounds``, each view gives the other its surest ``share`` of all unlabelled rows of each class, one at
    least. None without labels of both classes.
    """
    sample = labelled_sample(features, labels, "quality", per_class).toArrow().sort_by("doc_id")
    label, weight = sample["label"].to_numpy(), sample["weight"].to_numpy()
    if not {0, 1} <= set(label.tolist()):
        return None
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % 5 == 0 for i in sample["doc_id"].to_pylist()])
    views = _views(features)
    cells = [v.cells(_unpacked(sample[c])) for v, c in zip(views, ("content", "page"), strict=True)]
    widths = tuple(c.shape[1] for c in cells)
    plain = [v.edges for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = [View(e, np.zeros(0)) for e in plain]
        for batch in batches:
            if batch.num_rows:
                both = np.column_stack([v.cells(_unpacked(batch.column(c))) for v, c in zip(views, ("content", "page"), strict=True)]).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in both], pa.binary())], names=["cells"])

    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    pool = stored(features.join(named, "doc_id", "left_anti").select("content", "page").mapInArrow(run, "cells binary"), "quality-pool")
    count = pool.count()
    train = ~fold if {0, 1} <= set(label[~fold].tolist()) else np.ones(len(fold), bool)
    known = [(c[train], label[train].astype(float), weight[train]) for c in cells]
    given: list[list[Given]] = [[], []]
    weights = _fit(known, None, widths, given, [np.zeros(v.width) for v in views])
    for _ in range(rounds if count else 0):
        _handed_over(pool, widths, weights, given, max(1, int(share * count)))
        weights = _fit(known, pool, widths, given, weights)
    for view, w in zip(views, weights, strict=True):
        view.weights = w
    held = fold if len(set(label[fold].tolist())) == 2 else np.ones(len(fold), bool)
    return _calibrated(views, [c[held] for c in cells], label[held].astype(float), weight[held])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, text_score, page_score, score, predicted): probability of good quality of every row of ``docs``.

    Fitted on the labels whose crc32(doc_id) mod 3 is not 1. ``docs`` has (doc_id, text, lang, source, n_chars); nulls in
    any of them count as empty or unknown, empty texts are scored too, repeated rows get equal scores, other columns are
    ignored, an empty table gives an empty result; without labels of both classes all scores are 0.5. Whole texts count: every
    row's features are taken once and stored, and all rows without a label take part in co-training.
    """
    features = _features(docs)
    model = fit_quality(features, labels.where(~remainder("doc_id", 3, 1)))
    scored = "doc_id long, held_out boolean, text_score double, page_score double, score double, predicted int"
    rows = features.withColumn("held_out", remainder("doc_id", 3, 1))
    if model is None:
        even = F.lit(0.5)
        return rows.select("doc_id", "held_out", even.alias("text_score"), even.alias("page_score"), even.alias("score"), (even >= threshold).cast("int").alias("predicted"))
    plain = (astuple(model.text), astuple(model.page), model.combination)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, page, combination = shared.value
        model = QualityModel(View(*text), View(*page), combination)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, both = model.scores(_unpacked(batch.column("content")), _unpacked(batch.column("page")))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(a), pa.array(b), pa.array(both), pa.array((both >= threshold).astype(np.int32)),
            ], names=["doc_id", "held_out", "text_score", "page_score", "score", "predicted"])

    return rows.mapInArrow(run, scored)
