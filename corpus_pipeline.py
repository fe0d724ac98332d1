"""From documents to token files: toxic documents go, one of each group of near copies stays, documents that hold benchmark
items go, sources are mixed along a curriculum, and what remains is written as token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again for
the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.decontaminate import decontaminated
from groundline.llm.jaccard import one_of_each
from groundline.llm.mixing import training_order
from groundline.llm.queries import tokenizer_file
from groundline.llm.samples import remainder
from groundline.llm.storage import stored, table
from groundline.llm.token_files import token_files
from groundline.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_AT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``TOXIC_AT``; the classifier learns from the labels that aren't held out."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~remainder("doc_id", 3, 1)))
    scored = score_toxicity(docs, model, into="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC_AT).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar at 0.75 or more, directly or by others, the first one."""
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that training reads a document, in training order."""
    return training_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, read back from the token files."""
    return token_files(docs, tokenizer_file("byte_bpe_50k.json").decode(), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
