"""Report files to pages: Markdown, the metadata catalog, and PDF through an injected extractor."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions import text as T

log = logging.getLogger(__name__)

PAGE_MARK = r"(?Ui)<!--\s*(?:rag:)?page\s+(\d+)\s*-->"
DEFAULT_YEAR = "2025"
DEFAULT_TYPE = "memoria"
CATALOG = "file string, issuer string, doc_type string, year string, title string"
FILES = "file string, path string, sha256 string, content binary"


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(file, path, sha256, content) of a folder's files; an absent folder has none."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder)
    except AnalysisException:
        return spark.createDataFrame([], FILES)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "path",
        F.sha2("content", 256).alias("sha256"), "content")


def split_pages(text: Column) -> Column:
    """array<struct<page, text>> of a Markdown text; no page mark makes it one page."""
    clean = T.sanitize_tables(text)
    marks = F.regexp_extract_all(clean, F.lit(PAGE_MARK), F.lit(1))
    bodies = F.split(clean, PAGE_MARK, -1)

    def page(number: Column, i: Column) -> Column:
        return F.struct(
            F.coalesce(number.try_cast("long"), (i + 1).cast("long")).alias("page"),
            T.strip(F.get(bodies, i + 1)).alias("text"))

    whole = F.array(F.struct(F.lit(1).cast("long").alias("page"), T.strip(clean).alias("text")))
    pages = F.when(F.size(marks) == 0, whole).otherwise(F.transform(marks, page))
    return F.filter(pages, lambda p: p["text"] != "")


def markdown_pages(files: DataFrame) -> DataFrame:
    """(file, page, text); a file that is not valid UTF-8 gives no page."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("file", text.alias("text")).where("text IS NOT NULL").select(
        "file", F.explode(split_pages(F.col("text"))).alias("p")).select("file", "p.page", "p.text")


def unreadable_files(files: DataFrame) -> DataFrame:
    """Files that :func:`markdown_pages` skips."""
    return files.where(F.try_validate_utf8(F.col("content").cast("string")).isNull()).select("file")


def pypdf_text(data: bytes) -> list[str]:
    """Page texts of a PDF with the optional ``pypdf`` package."""
    import io

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]] = pypdf_text) -> DataFrame:
    """(file, page, text): pages numbered from 1, trimmed, empty ones dropped.

    A file the extractor cannot read is logged and skipped.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"]):
                try:
                    texts = extract(bytes(content))
                except Exception as error:  # a broken file must not fail the others
                    log.warning("cannot read %s: %s", file, error)
                    continue
                rows += [(file, i, t.strip()) for i, t in enumerate(texts, 1) if t.strip()]
            yield pd.DataFrame(rows, columns=["file", "page", "text"])

    return files.select("file", "content").mapInPandas(read, "file string, page long, text string")


def prefer_markdown(pdfs: DataFrame, markdown: DataFrame,
                    extract: Callable[[bytes], list[str]] = pypdf_text) -> DataFrame:
    """Pages of PDF files, read from the Markdown file of the same stem where there is one."""
    ready = markdown.select(stem(F.col("file")).alias("stem"), F.col("content").alias("md"))
    both = pdfs.withColumn("stem", stem(F.col("file"))).join(ready, "stem", "left")
    from_markdown = markdown_pages(both.where("md IS NOT NULL").select("file", F.col("md").alias("content")))
    return from_markdown.unionByName(pdf_pages(both.where("md IS NULL"), extract))


def read_catalog(spark: SparkSession, path: str | None) -> DataFrame:
    """Metadata per file name; a missing or malformed catalog is empty, and so is a field that is no string.

    The year may be a whole number too.
    """
    if path is None:
        return spark.createDataFrame([], CATALOG)
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], CATALOG)
    entry = raw.select(F.explode(F.from_json("value", "map<string,map<string,variant>>")).alias("file", "m"))

    def field(name: str, *kinds: str) -> Column:
        value = F.col("m")[name]
        allowed = F.schema_of_variant(value).isin("STRING", *kinds)
        return F.coalesce(F.when(allowed, F.try_variant_get(value, "$", "string")), F.lit("")).alias(name)

    return entry.select("file", field("issuer"), field("doc_type"), field("year", "BIGINT"), field("title"))


def metadata_from_name(file: Column) -> Column:
    """struct<issuer, doc_type, year, title> read from a file name."""
    pattern = r"(?U)^([A-Za-z0-9]+)_(.+)_(\d{4})\.(?:pdf|md)$"
    issuer, year = F.regexp_extract(file, pattern, 1), F.regexp_extract(file, pattern, 3)
    kind = F.replace(F.regexp_extract(file, pattern, 2), F.lit("_"), F.lit(" "))
    parts = F.split(stem(file), "[_-]")
    first_year = F.get(F.filter(parts, lambda p: p.rlike("^[0-9]{4}$")), F.lit(0))
    named = F.struct(issuer.alias("issuer"), kind.alias("doc_type"), year.alias("year"),
                     F.concat_ws(" ", issuer, kind, year).alias("title"))
    guessed = F.struct(
        F.get(parts, F.lit(0)).alias("issuer"), F.lit(DEFAULT_TYPE).alias("doc_type"),
        F.coalesce(first_year, F.lit(DEFAULT_YEAR)).alias("year"),
        F.replace(stem(file), F.lit("_"), F.lit(" ")).alias("title"))
    return F.when(file.rlike(pattern), named).otherwise(guessed)


def with_metadata(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add catalog metadata by file name, else by stem.pdf, else by stem.md, else from the name itself.

    Resolved once per file. The catalog may be as long as the file list, so Spark picks the join.
    """
    fields = ["issuer", "doc_type", "year", "title"]
    files = pages.select("file").distinct()
    keys = F.array(F.col("file"), F.concat(stem(F.col("file")), F.lit(".pdf")),
                   F.concat(stem(F.col("file")), F.lit(".md")))
    entry = catalog.select(F.col("file").alias("key"), F.struct(*fields).alias("entry"))
    found = files.select("file", F.posexplode(keys).alias("choice", "key")).join(entry, "key").groupBy("file").agg(
        F.min(F.struct("choice", "entry")).alias("best"))
    meta = files.join(found, "file", "left").select(
        "file", F.coalesce(F.col("best.entry"), metadata_from_name(F.col("file"))).alias("m"))
    return pages.join(meta, "file").select(
        F.col("file").alias("document"), "page", "text", *[f"m.{f}" for f in fields])
