import uuid

import pytest
from pyspark.sql import functions as F

from groundline.operators import index as X
from groundline.operators import pages as P
from groundline.operators import ranking as R
from groundline.plans.retrieval import retrieve
from groundline.sources.bucketed import BucketedStore


def corpus(spark):
    rows = []
    for doc in range(6):
        for page in range(1, 5):
            for p in range(2):
                text = f"ventas del puerto {doc} crecen en {page}00 millones, utilidad {'neta' if p else 'bruta'} del muelle {doc * page}"
                rows.append((f"d{doc}-{page}-{p}", f"d{doc}.md", page, f"Naviera{doc}", "memoria", "2025", f"Memoria {doc}", text, page * 2 + p, False))
    parents = spark.createDataFrame(rows, "parent_id string, document string, page long, issuer string, doc_type string, year string, title string, content string, p_idx long, is_toc boolean")
    parents = parents.withColumn("child_ids", F.array(F.concat("parent_id", F.lit("_0"))))
    children = parents.withColumn("child_id", F.concat("parent_id", F.lit("_0"))).withColumn("c_idx", F.lit(0)).drop("child_ids")
    return parents, children


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    parents, children = corpus(spark)
    index = X.build_text_index(children).checkpointed()
    name = f"t_{uuid.uuid4().hex}"
    store = BucketedStore.write(parents, children, index, str(tmp_path_factory.mktemp("store")), name)
    return parents, children, index, store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_pages_as_plain_tables(spark, stored):
    parents, children, index, store = stored
    asked = spark.createDataFrame([(1, "utilidad neta del puerto 3", None), (2, "muelle 8 ventas", None)], "query_id long, question string, issuer_filter string")
    plain = retrieve(asked, parents, children, index, 5)
    bucketed = retrieve(asked, store.parents, store.children, store.index, 5, places=store.places)
    rows = [sorted(map(str, df.collect())) for df in (plain, bucketed)]
    assert rows[0] and rows[0] == rows[1]


def test_sums_by_chunk_move_no_postings(spark, stored):
    store = stored[3]
    terms = spark.createDataFrame([(1, None, "puerto", 1.0)], "query_id long, issuer_filter string, term string, query_weight double")
    for postings in (store.index.tfidf, store.index.bm25):
        text = plan(R.score_terms(F.broadcast(terms), postings, ["query_id"]))
        assert "Exchange hashpartitioning" not in text and "Bucketed: true" in text


@pytest.mark.parametrize("case", ["pages", "evidence", "places"])
def test_joins_exchange_the_asking_side_only(spark, stored, case):
    store = stored[3]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hits = spark.createDataFrame([(1, "d1.md", 2, "Naviera1", 1.0, 0, True)], "query_id long, document string, page long, issuer string, score double, distance int, leads boolean")
        if case == "pages":
            joined = store.parents.join(hits, [*P.PAGE, "issuer"])
        elif case == "evidence":
            joined = store.children.join(hits.drop("issuer"), P.PAGE)
        else:
            joined = store.places.join(spark.createDataFrame([("d1-2-0_0",)], "child_id string"), "child_id", "left_semi")
        text = plan(joined)
        assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
        assert joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_reopened_by_name_and_names_are_checked(spark, stored):
    parents, children, index, store = stored
    assert store.places.count() == children.count()
    with pytest.raises(ValueError):
        BucketedStore.write(parents, children, index, "/nowhere", "a.b; c")
