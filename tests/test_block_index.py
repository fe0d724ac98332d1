import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from groundline.operators import ranking as R
from groundline.operators.block_index import BlockIndex
from groundline.session import cut_lineage

BY = ["query_id"]


def postings_of(spark, rows):
    return cut_lineage(spark.createDataFrame(rows, "term string, child_id string, issuer_key string, weight double"))


def terms_of(spark, rows):
    return spark.createDataFrame([(q, None, t, w) for q, t, w in rows], "query_id long, issuer_filter string, term string, query_weight double")


def brute(postings, terms, k):
    weights = defaultdict(dict)
    for term, child, _, weight in postings:
        weights[term][child] = weight
    out = []
    for query in {q for q, _, _ in terms}:
        scores = Counter()
        for q, term, w in terms:
            if q == query:
                for child, weight in weights[term].items():
                    scores[child] += w * weight
        best = sorted(((round(s, 9), c) for c, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        out += [(query, c, s) for s, c in best]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_same_rows_as_all_postings(spark, tmp_path, k):
    """Frequent and rare terms, equal weights, unknown terms, lists with fewer chunks than k."""
    rng = random.Random(k)
    rows = []
    for term, count in (("the", 300), ("of", 280), ("rare", 3), ("odd", 9), ("tied", 40)):
        rows += [(term, f"c{c}", "i", 1.0 if term == "tied" else round(rng.random() * 3 / math.log(count), 6)) for c in rng.sample(range(300), count)]
    terms = [(1, "the", 1.0), (1, "rare", 1.0), (1, "of", 2.0), (2, "tied", 1.0), (3, "nothing", 1.0), (4, "odd", 0.5), (4, "tied", 1.0), (4, "the", 3.0)]
    BlockIndex.build(postings_of(spark, rows), size=16).save(str(tmp_path))
    found = BlockIndex.load(spark, str(tmp_path)).search(terms_of(spark, terms), BY, k)
    assert sorted((r["query_id"], r["child_id"], r["score"]) for r in found.collect()) == brute(rows, terms, k)


def test_most_blocks_stay_unread(spark, tmp_path):
    """A frequent term of little weight is not read beside a telling one."""
    rows = [("often", f"c{i:04}", "i", 0.1 + (i % 7) / 100) for i in range(3000)] + [("telling", f"c{i:04}", "i", 5.0 + i / 100) for i in range(0, 3000, 60)]
    BlockIndex.build(postings_of(spark, rows), size=16).save(str(tmp_path))
    index = BlockIndex.load(spark, str(tmp_path))
    sizes = index.blocks.groupBy("term").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()
    assert {(r["term"], r["n"]) for r in sizes} == {("often", 3000), ("telling", 50)} and max(r["most"] for r in sizes) == 16
    terms = [(1, "often", 1.0), (1, "telling", 1.0)]
    best, every, read = index.searched(terms_of(spark, terms), BY, 10)
    assert sorted((r["query_id"], r["child_id"], r["score"]) for r in best.collect()) == brute(rows, terms, 10)
    assert read.count() < 0.2 * every.count()


CHUNKS = [
    ("a", "X", "profit grew and profit stayed", "roe"), ("b", "X", "roe is a ratio of profit", None), ("c", "Y", "nothing about it", "roe"),
    ("d", "Y", "cash and debt", "debt"), ("e", "Z", "", None),
]


def scores(spark, terms, **options):
    chunks = spark.createDataFrame(CHUNKS, "child_id string, issuer string, content string, indicator string")
    rows = [(1, None, t, 1.0, m) for t, m in terms]
    asked = spark.createDataFrame(rows, "query_id long, issuer_filter string, term string, query_weight double, required boolean")
    return {r["child_id"]: r["score"] for r in R.bm25_scores(asked, chunks, BY, **options).collect()}


def share(idf, tf, dl, average):
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))


def test_two_fields_have_their_own_statistics(spark):
    n = len(CHUNKS)
    words, named = [len(c[2].split()) for c in CHUNKS], sum(c[3] is not None for c in CHUNKS)
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    content, indicator = share(idf(1), 1, 6, sum(words) / n), share(idf(2), 1, 1, named / n)
    got = scores(spark, [("roe", False)], indicator=True)
    assert got == pytest.approx({"a": indicator, "b": content, "c": indicator}, abs=1e-8)
    assert scores(spark, [("roe", False)]) == pytest.approx({"b": content}, abs=1e-8)


def test_required_terms_in_any_field(spark):
    assert set(scores(spark, [("profit", False), ("roe", True)], indicator=True)) == {"a", "b", "c"}
    assert set(scores(spark, [("profit", True), ("roe", True)], indicator=True)) == {"a", "b"}
    assert scores(spark, [("profit", True), ("absent", True)], indicator=True) == {}
    assert set(scores(spark, [("profit", False), ("roe", False)], indicator=True)) == {"a", "b", "c"}


def test_forward_rows_are_shuffled_once_and_lie_in_order(spark, tmp_path):
    postings = spark.range(5000).selectExpr("concat('t', id % 7) AS term", "lpad(id % 900, 4, '0') AS child_id", "'a' AS issuer_key", "1.0D + id % 5 AS weight")
    index = BlockIndex.build(postings)
    plan = index.forward.sortWithinPartitions("child_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    index.save(str(tmp_path))
    for part in spark.read.parquet(f"{tmp_path}/forward").rdd.glom().collect():
        assert [r.child_id for r in part] == sorted(r.child_id for r in part)
