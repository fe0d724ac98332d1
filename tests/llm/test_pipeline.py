import collections

import pytest

import corpus_pipeline
from groundline.llm.queries import tokenizer_file
from groundline.llm.samples import remainder
from groundline.llm.token_files import ByteLevelTokenizer
from groundline.llm.toxicity import toxicity

from .helpers import SF, awkward, has_data, nothing, rows, similar_components

pytestmark = pytest.mark.skipif(not has_data(), reason="no test tables")


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    toxic = {r["doc_id"] for r in toxicity(docs, labels).where("predicted = 1").collect()}
    one = stage["toxicity"](spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in rows("documents") if r["doc_id"] not in toxic}
    assert one.columns == docs.columns and {r["doc_id"]: r["text"] for r in one.collect()} == texts
    two = stage["ngram_jaccard_join"](spark, one, SF)
    first = {k: texts[k] for k, c in similar_components(texts).items() if k == c}
    assert two.columns == docs.columns and {r["doc_id"]: r["text"] for r in two.collect()} == first
    three = stage["benchmark_decontamination"](spark, two, SF).cache()
    items = [r["text"] for r in rows("benchmark")]
    left = {r["doc_id"]: r["text"] for r in three.collect()}
    assert {k for k, t in first.items() if not any(i in t for i in items)} >= set(left) and len(left) > 0.8 * len(first)
    four = stage["mixing"](spark, three, SF).cache()
    read = collections.Counter(r["doc_id"] for r in four.collect())
    assert four.columns == docs.columns and set(read) <= set(left) and set(read.values()) <= {1, 2}
    five = stage["token_files"](spark, four, SF).collect()
    assert collections.Counter(r["doc_id"] for r in five) == read
    library = ByteLevelTokenizer(tokenizer_file("byte_bpe_50k.json").decode()).library
    assert all(r["n_tokens"] == len(library.encode(left[r["doc_id"]], add_special_tokens=False).ids) + 1 for r in five)
    spark.catalog.clearCache()


def test_run_gives_what_the_query_gives(spark):
    import __spark_entry__ as entry

    got = entry.queries()["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_awkward_rows(spark):
    for docs in (awkward(spark), nothing(spark)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "kind")
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == names, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_samples_leave_null_ids_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in df.select(remainder("doc_id", 3, 1)).collect()][0] is False
