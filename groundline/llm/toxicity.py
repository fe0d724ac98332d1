"""Toxic documents by multiple-instance learning.

Labels mark documents, offence sits in sentences. A sentence's probability is logistic in its words, a document's is the
noisy-or of its sentences with a leak for what no sentence explains: 1 - (1 - leak) * prod(1 - p). Training follows the
gradient of the document likelihood, so weight gathers in the sentences that tell the classes apart, and the same
sentence scores later locate the offence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.samples import labelled_sample, remainder
from groundline.llm.segments import LOWER, NO_WORD, mixed, passes, sequences, span_hashes, spans, text_bytes, words
from groundline.llm.storage import stored

#: Lengths of a word's beginnings that are features too.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Bytes that end a sentence.
SENTENCE_END = np.isin(np.arange(256), [ord(c) for c in ".!?\n\r"])


@dataclass
class ToxicityModel:
    """Sorted word hashes with weights; ``marks`` are the words that occur more often in toxic documents."""

    words: np.ndarray
    weights: np.ndarray
    marks: np.ndarray
    bias: float
    leak: float

    def sentence_scores(self, sentences: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentences that hold a marked word, and their log-odds."""
        distinct, inverse = np.unique(sentences, return_inverse=True)
        z = self.bias + np.bincount(inverse, self.weights[features], len(distinct))
        marked = np.bincount(inverse, self.marks[features], len(distinct)) > 0
        return distinct[marked], z[marked]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features with the number of their sentence; first sentence of each row; bytes and sentence ends.

    A word's features are the word and its first ``PREFIXES`` bytes, so that inflected forms share what they have learnt.
    """
    data, offsets = text_bytes(column)
    starts, ends, _ = spans(data, offsets, NO_WORD)
    final = SENTENCE_END[data]
    final[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True  # a row's last byte ends its last sentence
    past = np.concatenate(([0], np.cumsum(final)))
    begins, stops = [starts], [ends]
    for length in PREFIXES:
        longer = ends - starts > length
        begins.append(starts[longer])
        stops.append(starts[longer] + length)
    begin, stop = np.concatenate(begins), np.concatenate(stops)
    return span_hashes(LOWER[data], begin, stop), past[begin], past[offsets], data, np.flatnonzero(final) + 1


def _known(hashes: np.ndarray, sentences: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, feature) pairs of the features that the model knows."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    hit = words[at] == hashes
    pairs = np.unique(sentences[hit] * len(words) + at[hit])
    return pairs // len(words), pairs % len(words)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, features: int = 20_000, least_z: float = 3.5, steps: int = 300) -> ToxicityModel:
    """Fit on up to ``per_class`` labelled documents of each class (see ``labelled_sample``), of any length.

    Of copies among them one is used. Words and their beginnings are features when the document frequencies of the classes
    differ by ``least_z`` standard errors; of these at most ``features`` with the largest difference. Frequencies are counted
    on Spark; what reaches the driver are a sketch of each sampled document, the chosen features, and the places of chosen
    features in sentences that hold a marked one. Without labels of both classes (as in empty tables) the model scores every
    text 0.
    """
    nothing = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0, 0.0)
    sample = stored(labelled_sample(docs, labels, "toxic", per_class).select("doc_id", "text", "label", "weight"), "toxic-sample")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            hashes, rows = words(batch.column("text"), NO_WORD)
            sketch = [_sketch(hashes[a:b]).tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sketch, pa.binary())], names=["doc_id", "label", "sketch"])

    seen = sample.mapInArrow(sketches, "doc_id long, label int, sketch binary").toArrow().sort_by("doc_id")
    once = np.array(_one_of_each(seen["sketch"].to_pylist()), bool)
    used, label = seen["doc_id"].to_numpy()[once], seen["label"].to_numpy()[once]
    n1, n0 = int(label.sum()), int((1 - label).sum())
    if not n1 or not n0:
        return nothing

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            hashes, sentences, first, _, _ = _words(batch.column("text"))
            row = np.searchsorted(first, sentences, "right") - 1
            at = np.flatnonzero(np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), used)[row])
            found, row = hashes[at], row[at]
            order = np.lexsort((row, found))
            found, row = found[order], row[order]
            new = np.ones(len(found), bool)  # a feature counts once in a document
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            toxic = batch.column("label").to_numpy(zero_copy_only=False)[row[new]] == 1
            every, inverse = np.unique(found[new], return_inverse=True)
            counts = [np.bincount(inverse, w, len(every)).astype(np.int64) for w in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *map(pa.array, counts)], names=["feature", "toxic", "clean"])

    counted = sample.mapInArrow(frequencies, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(toxic / (n1 + 1 - toxic)) - F.log(clean / (n0 + 1 - clean))
    marked = counted.where("toxic + clean >= 5").select("feature", (odds / F.sqrt(1 / toxic + 1 / clean)).alias("z")).where(F.abs("z") >= least_z)
    best = marked.orderBy(F.abs("z").desc(), "feature").limit(features).toArrow()
    chosen, z = best["feature"].to_numpy().view(np.uint64), best["z"].to_numpy()
    order = np.argsort(chosen)
    chosen, z = chosen[order], z[order]
    marks = z > 0
    if not marks.any():
        return nothing

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            hashes, sentences, first, _, _ = _words(batch.column("text"))
            sentence, feature = _known(hashes, sentences, chosen)
            held = np.isin(sentence, sentence[marks[feature]])
            sentence, feature = sentence[held], feature[held]
            cuts = np.searchsorted(sentence, first)
            pairs = [((sentence[a:b] - f).astype(np.int32).tobytes(), feature[a:b].astype(np.int32).tobytes()) for a, b, f in zip(cuts[:-1], cuts[1:], first, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), batch.column("weight"), *[pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)]],
                names=["doc_id", "label", "weight", "sentences", "features"],
            )

    bag = sample.mapInArrow(bags, "doc_id long, label int, weight double, sentences binary, features binary").toArrow().sort_by("doc_id")
    bag = bag.filter(pa.array(np.isin(bag["doc_id"].to_numpy(), used)))
    pairs = [tuple(np.frombuffer(x, np.int32) for x in row) for row in zip(bag["sentences"].to_pylist(), bag["features"].to_pylist(), strict=True)]
    return _fit(pairs, bag["label"].to_numpy(), bag["weight"].to_numpy(), chosen, z, steps)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Least hashes of the three-word sequences under eight orders; copies share most of them."""
    runs = sequences(hashes, min(3, max(1, len(hashes))))
    return np.array([mixed(runs ^ np.uint64(i)).min() if len(runs) else 0 for i in range(1, 9)], np.uint64)


def _one_of_each(sketches: list[bytes]) -> list[bool]:
    """Whether a sampled document shares no sketch value with an earlier one: a label that was copied counts once."""
    seen, first = set(), []
    for sketch in sketches:
        values = {(i, v) for i, v in enumerate(np.frombuffer(sketch, np.uint64).tolist())}
        first.append(seen.isdisjoint(values))
        seen |= values
    return first


def _fit(pairs, label, weight, words, z, steps) -> ToxicityModel:
    """``pairs``: for each document (sentence, feature) of the sentences that hold a marked feature."""
    marks = (z > 0).astype(float)
    pair_sentence, pair_feature, owner, total = [], [], [], 0
    for doc, (found, feature) in enumerate(pairs):
        distinct, inverse = np.unique(found, return_inverse=True)
        pair_sentence.append(total + inverse)
        pair_feature.append(feature)
        owner.append(np.full(len(distinct), doc))
        total += len(distinct)
    pair_sentence, pair_feature, owner = np.concatenate(pair_sentence), np.concatenate(pair_feature), np.concatenate(owner)
    weight = weight / weight.sum()
    # parameters: words, bias, log-odds of the leak; Adam on the weighted log-likelihood
    theta = np.concatenate([np.where(z > 0, 1.0, 0.0), [-1.0, -3.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n = len(words)
    for step in range(1, steps + 1):
        logit = theta[n] + np.bincount(pair_sentence, theta[pair_feature], total)
        clear = np.bincount(owner, np.logaddexp(0, logit), len(label)) + np.logaddexp(0, theta[n + 1])
        toxic = np.maximum(-np.expm1(-clear), 1e-9)
        pull = weight * np.where(label == 1, np.exp(-clear) / toxic, -1.0)  # derivative by the sum of softplus terms
        by_logit = pull[owner] / (1 + np.exp(-logit))
        gradient = np.concatenate([
            np.bincount(pair_feature, by_logit[pair_sentence], n) - 1e-5 * theta[:n],
            [by_logit.sum(), pull.sum() / (1 + np.exp(-theta[n + 1]))],
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(words, theta[:n], marks, float(theta[n]), float(1 / (1 + np.exp(-theta[n + 1]))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``, from 0 to 1; all columns stay (one of that name is replaced).

    Every sentence of the whole text counts. Null and empty texts get the leak alone. Row by row, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # plain arrays
    kept = [c for c in docs.columns if c != into]
    schema = docs.select(*kept).withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            model = ToxicityModel(*shared.value)
            hashes, sentences, first, _, _ = _words(batch.column("text"))
            found, logits = model.sentence_scores(*_known(hashes, sentences, model.words))
            row = np.searchsorted(first, found, "right") - 1
            clear = np.bincount(row, np.logaddexp(0, logits), batch.num_rows)
            score = 1 - (1 - model.leak) * np.exp(-clear)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(score, 0.0, 1.0))], names=[*kept, into])

    return docs.select(*kept).mapInArrow(run, schema)


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, sentence, probability) of all sentences of ``docs(doc_id, text)`` at or above the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # plain arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            model = ToxicityModel(*shared.value)
            hashes, sentences, first, data, ends = _words(batch.column("text"))
            found, logits = model.sentence_scores(*_known(hashes, sentences, model.words))
            p = 1 / (1 + np.exp(-logits))
            found, p = found[p >= threshold], p[p >= threshold]
            row = np.searchsorted(first, found, "right") - 1
            raw = data.tobytes()
            texts = [raw[(ends[s - 1] if s else 0) : ends[s]].decode().strip() for s in found.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(found - first[row]), pa.array(texts, pa.string()), pa.array(p)],
                names=["doc_id", "sentence_no", "sentence", "probability"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, sentence_no long, sentence string, probability double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted on the labels whose crc32(doc_id) mod 3 is not 1, scored on all rows.

    Nulls: a null text scores like an empty one, a null ``doc_id`` is never labelled and not held out. Repeated rows
    get equal scores. Columns other than ``doc_id`` and ``text`` are never looked at.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_toxicity(narrow, labels.where(~remainder("doc_id", 3, 1)))
    scored = score_toxicity(narrow.withColumn("held_out", remainder("doc_id", 3, 1)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
