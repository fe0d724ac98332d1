import pytest
from pyspark.sql import functions as F

from groundline.operators import index as X
from groundline.operators import ranking as R
from groundline.operators.scan import best_bm25, best_postings, best_tfidf

BY = ["query_id"]
SAME = "child_id string, content string, issuer string, indicator string"


def table(spark, twice):
    rows = [(str(i), " ".join(f"palabra{j}" for j in range(i % 7 + 1)) + f" cifra{i} banco banco", f"emisor{i % 3}", "deuda" if i % 4 == 0 else None) for i in range(60)]
    rows += [("60", "", "emisor1", None), ("61", None, "emisor1", None), (None, "banco palabra1", None, "deuda"), (None, "banco", None, None)]
    return spark.createDataFrame(rows + rows[:9] * twice, SAME)


def scored(df):
    return sorted(((r["query_id"], r["issuer_filter"], r["child_id"], r["issuer_key"], round(r["score"], 6), r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("twice", [0, 1])
@pytest.mark.parametrize("indicator", [False, True])
def test_scan_finds_what_the_shuffled_scores_rank(spark, twice, indicator):
    chunks = table(spark, twice)
    terms = spark.createDataFrame([(q, f, t, w, t == "palabra3") for q, f in ((1, None), (2, "emisor1"), (3, "")) for t, w in (("banco", 1.0), ("palabra3", 2.0), ("cifra7", 1.0), ("deuda", 1.0))],
                                  "query_id long, issuer_filter string, term string, query_weight double, required boolean")
    for asked in (terms.drop("required"), terms):
        slow = R.bm25_rank(R.bm25_scores(asked, chunks, BY, indicator=indicator), BY, 5)
        assert scored(R.bm25_rank(best_bm25(asked, chunks, BY, 5 * R.BM25_WIDTH, indicator), BY, 5)) == scored(slow) != []
    packed = X.packed_counts(chunks).cache()
    vocabulary = X.smoothed_idf(X.document_frequency(X.unpacked(packed)), chunks).cache()
    plain = terms.drop("required")
    slow = R.tfidf_rank(R.score_terms(plain, X.tfidf_postings(X.unpacked(packed), vocabulary), BY), BY, 5)
    assert scored(R.tfidf_rank(best_tfidf(plain, packed, vocabulary, BY, 5), BY, 5)) == scored(slow) != []


def test_a_task_returns_a_bounded_number_of_rows(spark):
    chunks = spark.range(2000).select(F.col("id").cast("string").alias("child_id"), F.lit("banco").alias("content"), F.lit("a").alias("issuer")).repartition(3)
    terms = spark.createDataFrame([(1, None, "banco", 1.0)], "query_id long, issuer_filter string, term string, query_weight double")
    best = best_bm25(terms, chunks, BY, 4)
    assert best.count() <= 4 * best.rdd.getNumPartitions() and {r["child_id"] for r in R.bm25_rank(best, BY, 4, 1).collect()} == {"0", "1", "10", "100"}


def test_counting_moves_no_text(spark):
    plan = X.term_counts(table(spark, 0).where("child_id IS NOT NULL"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_only_rare_terms_move_for_their_idf(spark):
    counts = X.term_counts(table(spark, 0)).cache()
    vocabulary = X.smoothed_idf(X.document_frequency(counts), table(spark, 0)).cache()
    got = X.attach_by_term(counts, vocabulary, hot_terms=10)
    want = counts.join(vocabulary.select("term", "idf"), "term")
    assert sorted(got.select("child_id", "term", "tf", "idf").collect(), key=str) == sorted(want.select("child_id", "term", "tf", "idf").collect(), key=str)


def test_only_chunks_that_may_rank_get_their_norm(spark, monkeypatch):
    """Bounds from frequent terms pick the chunks; the best ones are those of the full ranking."""
    import numpy as np
    from groundline.operators import scan as S
    from groundline.plans.queries import QID, plain_terms, tfidf_lists, tfidf_statistics

    rng = np.random.default_rng(5)
    texts = [" ".join([f"w{int(x)}" for x in rng.zipf(1.3, 40) if x < 5000] + [f"rare{i}"]) for i in range(600)]
    chunks = spark.createDataFrame([(str(i), t, "a") for i, t in enumerate(texts)], "child_id string, content string, issuer string")
    asked = spark.createDataFrame([(1, "w5 w9 w17", None), (2, "w30 rare7", None)], "query_id long, question string, issuer_filter string")
    seen, whole = [], X.chunk_norms
    split = X.hot_and_cold
    monkeypatch.setattr(X, "hot_and_cold", lambda vocabulary, hot_terms=200: split(vocabulary, 200))
    monkeypatch.setattr(S.X, "chunk_norms", lambda counts, vocabulary: (seen.append(counts.select("child_id").distinct().count()), whole(counts, vocabulary))[1])
    found = {(r.query_id, r.child_id, round(r.score, 6)) for r in tfidf_lists(asked, chunks, 5).collect()}
    monkeypatch.undo()
    packed, vocabulary = tfidf_statistics(chunks)
    weighed = R.query_term_weights(plain_terms(asked), vocabulary, QID)
    wanted = R.tfidf_rank(R.score_terms(weighed, X.tfidf_postings(X.unpacked(packed), vocabulary), QID), QID, 5)
    assert found == {(r.query_id, r.child_id, round(r.score, 6)) for r in wanted.collect()}
    assert seen and seen[0] < 300


def test_two_fields_of_a_chunk_are_not_gathered_by_a_shuffle(spark, monkeypatch):
    from groundline.operators import scan as S
    from groundline.plans.queries import QID

    chunks = spark.createDataFrame([("1", "one two", "a", "x"), ("2", "two", "a", None)], "child_id string, content string, issuer string, indicator string")
    terms = spark.createDataFrame([(1, None, "two", 1.0), (1, None, "x", 1.0)], "query_id long, issuer_filter string, term string, query_weight double")
    plans, best = [], S._best
    monkeypatch.setattr(S, "_best", lambda parts, *rest: (plans.append(parts._jdf.queryExecution().executedPlan().toString()), best(parts, *rest))[1])
    rows = S.best_bm25(terms, chunks, QID, 5, True).collect()
    assert [r.child_id for r in sorted(rows, key=lambda r: -r.score)] == ["1", "2"] and "Exchange" not in plans[0]


def test_rare_terms_spread_over_tasks_that_grow_with_the_rows(spark, monkeypatch):
    counts = spark.range(3000).selectExpr("cast(id % 50 AS string) AS child_id", "'a' AS issuer_key", "60L AS dl", "concat('t', id) AS term", "1L AS tf")
    vocabulary = X.document_frequency(counts).selectExpr("term", "df", "cf", "2.0D AS idf")
    monkeypatch.setattr(X, "ROWS_PER_TASK", 100)
    rows = X.attach_by_term(counts, vocabulary, 1)
    assert "hashpartitioning(term" in rows._jdf.queryExecution().optimizedPlan().toString() or "RepartitionByExpression [term" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 3000
    plan = X.tfidf_postings(counts, vocabulary)
    # the counts are read by the frequent and the rare side, and not again for the norms
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    assert {round(r.weight, 9) for r in plan.collect()} == {round(60 ** -0.5, 9)}


ODD = ["Año ÁRBOL pingüino Öl straße", "İstanbul ΟΔΟΣ ΣΑΣ'Α ΣΣ", "…—«uno»• dos", " ", "", None, "\tfin.\n", "aͅb éé ⓐx Ⅳ½²x ٣٤ 漢字かな 𝔘𝟘 \U0001f600z", "K ſ ǅ ñÑ x\u0000y z w", "Ã© é©Ãã", "12,5% a_b"]


def test_texts_cut_in_tasks_give_the_analysed_terms(spark):
    import pyarrow as pa
    from groundline.functions import text as T
    from groundline.operators import scan as S

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, content string")
    got = rows.select("i", T.analysed_terms(F.col("content")).alias("terms"), T.analysed_text(F.col("content")).alias("text")).orderBy("i").collect()
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(["x", *[r.text for r in got]], kind)
        assert S._cut(texts.slice(1)).to_pylist() == [r.terms for r in got]
        assert S._cut(texts.slice(0, 0)).to_pylist() == S._cut(pa.array([], kind)).to_pylist() == [] and S._cut(pa.array([None], kind)).to_pylist() == [None]


def test_terms_stay_in_the_task_that_reads_their_text(spark, monkeypatch):
    """Only texts are handed to tasks that match; no term is made a row value of its own before."""
    from groundline.operators import scan as S

    plans, keep = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df, label))[1])
    terms = spark.createDataFrame([(1, None, "banco", 1.0)], "query_id long, issuer_filter string, term string, query_weight double")
    assert best_bm25(terms, table(spark, 1), BY, 4).count() and best_bm25(terms, table(spark, 0).where("child_id IS NOT NULL"), BY, 4).count()
    assert len(plans) == 2 and not any("regexp_extract_all" in p for p in plans)


def test_best_texts_are_sorted_a_few_times_only(monkeypatch):
    """Merges grow with the logarithm of the rows; the best are those of one sort over all."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from groundline.operators import scan as S

    rng = np.random.default_rng(3)
    keys = [(q, None) for q in range(20)]
    asked = S.Asked(keys, [None] * 20, [], np.array([0]), np.array([]), np.array([]), np.array([]), np.zeros(20, "int64"))
    best, sorts = S._BestTexts(asked, None, 5, False), []
    concat = pd.concat
    monkeypatch.setattr(S.pd, "concat", lambda *a, **k: (sorts.append(1), concat(*a, **k))[1])
    scores = np.round(rng.integers(0, 400, (4000, 20)) / 7, 9)
    names = pa.array([f"c{i}" for i in range(4000)])
    for low in range(0, 4000, 10):
        best._take(low, scores[low : low + 10], names.slice(low, 10), names.slice(low, 10))
    got = best.result().to_pandas()
    assert len(sorts) < 200
    for q in range(20):
        wanted = sorted(((-s, n.as_py()) for s, n in zip(scores[:, q], names) if s > 0))[:5]
        assert sorted((-r.score, r.child_id) for r in got[got["list"] == q].itertuples()) == wanted


@pytest.mark.parametrize("filtered", [False, True])
def test_stored_postings_score_in_the_tasks_that_read_them(spark, filtered):
    rows = [(f"t{t}", f"c{c}", f"e{c % 3}" if c % 5 else None, (c * 7 + t * 3) % 11 / 10 + 0.1) for c in range(40) for t in range(6) if (c + t) % 3]
    rows += [("t1", "c1", "e1", 0.5), ("t2", None, "e1", 0.4), ("other", "c2", "e2", 9.0)]  # a copy, a chunk without an id
    postings = spark.createDataFrame(rows, "term string, child_id string, issuer_key string, weight double").repartition(3, "child_id").cache()
    terms = spark.createDataFrame([(q, f, f"t{t}", q + t / 10) for q, f in ((1, None), (2, "e1"), (3, "")) for t in range(q, 6)],
                                  "query_id long, issuer_filter string, term string, query_weight double")
    rank = R.tfidf_rank if filtered else R.bm25_rank
    k = 4 if filtered else 4 * R.BM25_WIDTH
    found = best_postings(terms, postings, BY, k, filtered)
    assert scored(rank(found, BY, 4)) == scored(rank(R.score_terms(terms, postings, BY), BY, 4))
    # at most k rows of each task and list, and no row for a posting and a list
    assert found.count() <= 3 * 3 * k
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
    assert scored(rank(best_postings(terms.where("query_id > 9"), postings, BY, k, filtered), BY, 4)) == []


def test_retrieval_scores_few_terms_by_scan(spark, monkeypatch):
    from groundline.operators import decomposition as D
    from groundline.plans import retrieval

    chunks = table(spark, 0).withColumns({"document": F.lit("d"), "title": F.lit("t")}).where("child_id IS NOT NULL")
    index = X.build_text_index(chunks.drop("indicator")).checkpointed()
    asked = spark.createDataFrame([(1, "banco con palabra3 y cifra7", None)], "query_id long, question string, issuer_filter string")
    lists = lambda: sorted(map(tuple, retrieval.ranked_lists(asked, D.subqueries(asked, index.titles), index, None).collect()))
    by_scan = lists()
    monkeypatch.setattr(retrieval, "fits_broadcast", lambda df, *a: False)
    assert by_scan and by_scan == lists()
    monkeypatch.undo()
    monkeypatch.setattr(R, "score_terms", None)
    assert by_scan == lists()
