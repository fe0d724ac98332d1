import os

import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# Quick queries of every family; the rest runs in the correctness gate.
CHECKED = ["tokenize_counts", "tfidf_topk", "bm25_postfilter_issuer", "vector_label_filter", "number_locations",
           "grounding_verdict", "sanitize_text", "attribution_findings", "recursive_chunks", "pipe_table_rows",
           "indicator_match", "query_expansion", "clause_split", "catalog_coalesce", "strip_think",
           "dictionary_matches", "contained_names"]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    return "" if value is None else f"{value:.5f}" if isinstance(value, float) else str(value)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@needs_data
def test_flagship(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["query_id", "rank", "child_id", "score"] and df.limit(1).count() == 1


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(tuple(map(plain, row)) for row in cursor.fetchall())
    df = entry_point.queries()[name](spark, SF).select(*columns)
    assert sorted(tuple(map(plain, row)) for row in df.collect()) == expected
