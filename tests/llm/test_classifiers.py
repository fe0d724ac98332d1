import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from groundline.llm import quality as Q
from groundline.llm import toxicity as T

from .helpers import awkward, nothing

LARGER = "/root/testdata/sf0.01"


def corpus(spark, n=600, seed=0):
    """Documents in which two or three bad sentences make every third one toxic."""
    rng = random.Random(seed)
    good, bad = [f"word{i}" for i in range(300)], ["vile", "vilest", "rotten", "rottenly"]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(good) for _ in range(8)) for _ in range(rng.randint(2, 9))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(2, 3)):
                s = rng.randrange(len(sentences))
                sentences[s] += " " + rng.choice(bad)
        docs.append((i, ". ".join(sentences) + ".", None))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    got = T.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = corpus(spark, 150)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert sorted(T.toxicity(docs, labels).collect()) == sorted(T.toxicity(docs, turned).collect())


def test_offending_sentences(spark):
    docs, labels, _ = corpus(spark)
    model = T.fit_toxicity(docs, labels)
    found = T.offending_sentences(docs, model, threshold=0.4).collect()
    assert found and all("vile" in r["sentence"] or "rotten" in r["sentence"] for r in found)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(text[r["doc_id"]].split(". ")[r["sentence_no"]].strip(".") == r["sentence"].strip(".") for r in found)


def test_toxicity_of_awkward_rows(spark):
    docs, labels, _ = corpus(spark, 150)
    model = T.fit_toxicity(docs, labels)
    odd = awkward(spark)
    scored = T.score_toxicity(odd, model)
    assert sorted(scored.columns) == sorted(odd.columns) and scored.count() == odd.count()
    assert all(r["score"] == pytest.approx(model.leak) for r in scored.collect())
    assert T.toxicity(nothing(spark), labels).collect() == []
    assert {r["score"] for r in T.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    strange = spark.createDataFrame([(1, None), (1, 1), (None, 1), (2, 7), (4, 0), (6, 0), (3, 1)], "doc_id long, toxic int")
    assert T.toxicity(odd, strange).count() == odd.count()


@pytest.mark.skipif(not __import__("os").path.isdir(LARGER), reason="no test tables")
def test_queries_on_held_out_rows(spark):
    import __spark_entry__ as entry

    labels = pq.read_table(f"{LARGER}/labels.parquet").to_pandas().set_index("doc_id")
    toxic = entry.queries()["op10_toxicity"](spark, LARGER).toPandas().set_index("doc_id").join(labels)
    held = toxic[toxic.held_out & toxic.toxic.notna()]
    assert (held.predicted == held.toxic).mean() >= 0.93 and ((held.predicted == 1) & (held.toxic == 0)).sum() <= 2
    good = entry.queries()["op6_quality_classifier"](spark, LARGER).toPandas().set_index("doc_id").join(labels)
    held = good[good.held_out & good.quality.notna()]
    assert (held.predicted == held.quality).mean() >= 0.93
    assert len(toxic) == len(good) == pq.read_metadata(f"{LARGER}/documents.parquet").num_rows


def test_co_training_uses_the_other_view(spark):
    rng = np.random.default_rng(0)
    n, width = 3000, len(Q.CLASSES) + 3
    y = rng.integers(0, 2, n)
    texts = np.column_stack([y[:, None] + rng.normal(size=(n, 3)), np.zeros((n, width - 3))])
    pages = np.column_stack([rng.integers(0, 16, n), rng.integers(0, 64, n), 2 * y + rng.normal(size=n)])
    packed = [(i, t.astype(np.float32).tobytes(), p.astype(np.float32).tobytes()) for i, (t, p) in enumerate(zip(texts, pages, strict=True))]
    features = spark.createDataFrame(packed, "doc_id long, content binary, page binary")
    known = 200  # a fifth of them calibrates; a dozen rows can turn a view's sign
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(known)], "doc_id long, quality int")
    scores = {turns: Q.fit_quality(features, labels, rounds=turns).scores(texts[known:], pages[known:]) for turns in (0, 5)}
    right = {turns: [((s > 0.5) == y[known:]).mean() for s in found] for turns, found in scores.items()}
    assert right[5][2] >= 0.85 and right[5][2] >= max(right[5][:2]) - 0.03
    assert sum(right[5][:2]) > sum(right[0][:2])  # both views together learn from each other


def test_quality_of_awkward_rows(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(30)) if i % 2 else "!!! ### " * 20, "en", f"s{i % 3}", 100) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    got = Q.quality(df, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got) and len(got) == 200
    odd = awkward(spark)
    assert Q.quality(odd, labels.limit(0)).count() == odd.count()
    mixed = odd.select(df.columns).unionByName(df)
    got = Q.quality(mixed, labels).collect()
    assert len(got) == 211 and all(0 <= r[c] <= 1 for r in got for c in ("score", "text_score", "page_score"))
    assert Q.quality(nothing(spark), labels).collect() == []


def test_every_unlabelled_row_takes_part_in_co_training(spark, monkeypatch):
    pools = []
    plain = Q._handed_over

    def watched(pool, widths, weights, given, each):
        plain(pool, widths, weights, given, each)
        pools.append((pool.count(), each, len(given[0]), len(given[1])))

    monkeypatch.setattr(Q, "_handed_over", watched)
    rng = random.Random(2)
    long = "clean words here " * 15_000  # above 200,000 bytes
    docs = [(i, long if i == 9000 else f"w{rng.randint(0, 50)} " * 3 if i % 2 else "!!! # ", "en", "s", 10) for i in range(9001)] + [(None, "w1", "en", "s", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2 if i < 100 else None) for i in range(101)], "doc_id long, quality int")
    model = Q.fit_quality(Q._features(df), labels)
    assert model is not None and pools == [(8902, 178, turn, turn) for turn in range(1, 6)]
    pools.clear()
    Q.fit_quality(Q._features(df.where("doc_id < 110")), labels)  # fewer than 50 rows still hand over one for each class
    assert [p[:2] for p in pools] == [(10, 1)] * 5


@pytest.mark.parametrize("fan_in", [16, 2])
def test_fit_on_spark_is_the_plain_fit(spark, monkeypatch, fan_in):
    monkeypatch.setattr(Q, "FAN_IN", fan_in)
    rng = np.random.default_rng(5)
    cells = [np.column_stack([rng.integers(0, 4, 300), 4 + rng.integers(0, 3, 300), np.full(300, 7)]) for _ in range(2)]
    rows = [(np.concatenate([a, b]).astype(np.uint16).tobytes(),) for a, b in zip(*cells, strict=True)]
    pool = spark.createDataFrame(rows, "cells binary").repartition(7)
    known = [(c[:40], (c[:40, 0] > 1).astype(float), np.ones(40)) for c in cells]
    source = np.array([-3.0, -1.5, 1.5, 3.0, 0.0, 0.0, 0.0, 0.0])
    given = [[Q.Given(source, -1.5 * Q.GRID, 0.25, 1.5 * Q.GRID, 0.5)] for _ in range(2)]
    got = Q._fit(known, pool, (3, 3), given, [np.zeros(8), np.zeros(8)])
    for view in (0, 1):
        first = cells[1 - view][:, 0]
        label, weight = (first > 1).astype(float), np.array([1.0, 0.25, 0.5, 1.0])[first]
        every = np.concatenate([known[view][0], cells[view]])
        x = np.zeros((len(every), 8))
        np.put_along_axis(x, every, 1.0, axis=1)
        want = Q._newton(x, np.concatenate([known[view][1], label]), np.concatenate([np.ones(40), weight]), 1.0)
        assert np.abs(got[view] - want).max() < 1e-6
    assert Q._border(np.array([1.0, 2.0, 3.0]), np.array([2, 4, 1]), 3) == (2.0, 0.25)
