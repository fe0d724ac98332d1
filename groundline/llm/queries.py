"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from groundline.llm.oracles import ORACLES as ORACLES
from groundline.llm.storage import table


def tokenizer_file(name: str) -> bytes:
    """Content of a public tokenizer's file; read on the driver and sent to the tasks (2 MB at most)."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.chat import digest, expand

    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(expand(turns.unionByName(own)))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.jaccard import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(vectors["vec_id"] % 100 == 0), k=10, factor=1.0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json").decode(), end_id=2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.word_bpe import round_trip_digest

    return round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.merkle import fifth, manifest

    docs = table(spark, sf_dir, "documents")
    return manifest(docs, fifth(docs["doc_id"]))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundline.llm.whitening import whitened_rows

    return whitened_rows(table(spark, sf_dir, "embeddings"), most=16)


QUERIES = [op1_mixing, op2_chat_formatting, op3_ngram_jaccard_join, op4_lm_scoring, op5_nearest_neighbours, op6_quality_classifier, op7_benchmark_decontamination, op8_token_files, op9_token_counts, op10_toxicity, op11_bpe_round_trip, op12_merkle_manifest, op13_embedding_whitening]

