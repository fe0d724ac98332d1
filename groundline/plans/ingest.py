"""Report folder to corpus and search index."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.operators.chunking import child_chunks, parent_chunks, with_child_ids
from groundline.operators.index import TextIndex, build_text_index
from groundline.operators.number_index import number_index
from groundline.session import cut_lineage
from groundline.sources import files as S
from groundline.sources.corpus import Corpus

log = logging.getLogger(__name__)


def corpus_from_pages(pages: DataFrame, files: DataFrame | None = None, strict: bool = False,
                      dictionary: Dictionary = DEFAULT_DICTIONARY) -> Corpus:
    """Chunks and number index of pages(document, page, text, issuer, doc_type, year, title)."""
    spark = pages.sparkSession
    if files is None:
        files = spark.createDataFrame([], "file string, sha256 string")
    parents = parent_chunks(pages, dictionary=dictionary)
    children = child_chunks(parents, strict=strict, dictionary=dictionary)
    manifest = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated"))
    return Corpus(with_child_ids(parents, children), children, number_index(pages), files, manifest)


def pages_from_folder(spark: SparkSession, folder: str, catalog_path: str | None,
                      extract_pdf: Callable[[bytes], list[str]] = S.pypdf_text) -> tuple[DataFrame, DataFrame]:
    """(pages, files) of ``folder``/markdown, or of ``folder``/pdfs when no Markdown page was found."""
    catalog = S.read_catalog(spark, catalog_path)
    files = S.list_files(spark, f"{folder}/markdown", "md")
    for row in S.unreadable_files(files).toLocalIterator():  # every skipped file, one task's names at a time
        log.warning("skipped %s: not valid UTF-8", row["file"])
    pages = cut_lineage(S.with_metadata(S.markdown_pages(files), catalog))
    if pages.isEmpty():
        pdfs = S.list_files(spark, f"{folder}/pdfs", "pdf")
        files = files.unionByName(pdfs)
        pages = cut_lineage(S.with_metadata(S.prefer_markdown(
            pdfs, S.list_files(spark, f"{folder}/markdown", "md"), extract_pdf), catalog))
    if pages.isEmpty():
        raise ValueError(f"no pages found under {folder}")
    return pages, files.select("file", "sha256")


def build_corpus(spark: SparkSession, folder: str, catalog_path: str | None = None, strict: bool = False,
                 dictionary: Dictionary = DEFAULT_DICTIONARY,
                 extract_pdf: Callable[[bytes], list[str]] = S.pypdf_text) -> Corpus:
    pages, files = pages_from_folder(spark, folder, catalog_path, extract_pdf)
    return corpus_from_pages(pages, files, strict, dictionary)


def load_or_build(spark: SparkSession, folder: str, store: str, force: bool = False,
                  strict: bool = False, dictionary: Dictionary = DEFAULT_DICTIONARY) -> tuple[Corpus, TextIndex]:
    """Stored corpus and index, else the JSON copy, else a fresh build of ``folder`` that is stored."""
    if not force:
        try:
            corpus = Corpus.load(spark, f"{store}/corpus")
            return corpus, TextIndex.load(spark, f"{store}/index")
        except PySparkException as error:
            log.info("no stored corpus (%s)", type(error).__name__)
        try:
            return _with_index(spark, Corpus.load_json(spark, f"{store}/corpus_json"), store, dictionary)
        except PySparkException as error:
            log.info("no JSON corpus (%s)", type(error).__name__)
    corpus = build_corpus(spark, folder, f"{folder}/document_metadata.json", strict, dictionary)
    corpus.save(f"{store}/corpus")
    corpus = Corpus.load(spark, f"{store}/corpus")
    corpus.save_json(f"{store}/corpus_json")
    return _with_index(spark, corpus, store, dictionary)


def _with_index(spark: SparkSession, corpus: Corpus, store: str, dictionary: Dictionary) -> tuple[Corpus, TextIndex]:
    build_text_index(corpus.children, dictionary).save(f"{store}/index")
    return corpus, TextIndex.load(spark, f"{store}/index")
