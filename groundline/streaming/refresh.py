"""Incremental ingest: files that arrive in a folder become rows of the stored corpus, and only theirs are written.

Arrivals are read as a file stream until none is left (``availableNow``). A file whose SHA-256 is the stored one is skipped;
the others are chunked, and their rows appended as the next generation of each table. The newest generation of a file is the
current one, so a changed file is swapped by its own rows and no other row is read or rewritten. A batch that is run again after a
failure overwrites its own generation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.plans.ingest import corpus_from_pages
from groundline.session import cut_lineage
from groundline.sources import files as S
from groundline.sources.corpus import Corpus

ARRIVAL = "path string, modificationTime timestamp, length long, content binary"
TABLES = ("parents", "children", "number_index")
NOT_UTF8, NO_PAGES = "not valid UTF-8", "no text"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing written yet
        return None


def manifest(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """(file, sha256, generation) of every file's current version, or of the one before a generation."""
    rows = _stored(spark, f"{store}/manifest")
    if rows is None:
        return spark.createDataFrame([], "file string, sha256 string, generation long")
    if before is not None:
        rows = rows.where(F.col("generation") < before)
    newest = F.max(F.struct(F.col("generation").cast("long").alias("generation"), "sha256")).alias("n")
    return rows.groupBy("file").agg(newest).select("file", "n.sha256", "n.generation")


def skipped(spark: SparkSession, store: str) -> DataFrame:
    """(file, reason, sha256, generation) of arrivals that gave no rows."""
    rows = _stored(spark, f"{store}/skipped")
    return spark.createDataFrame([], "file string, reason string, sha256 string, generation long") if rows is None else rows.select(
        "file", "reason", "sha256", F.col("generation").cast("long"))


def current(spark: SparkSession, store: str) -> Corpus:
    """The corpus of all current versions. Raises ValueError before the first file is stored."""
    versions = manifest(spark, store)
    tables = {}
    for name in TABLES:
        rows = _stored(spark, f"{store}/{name}")
        if rows is None:
            raise ValueError(f"no corpus in {store}")
        live = versions.select(F.col("file").alias("document"), F.col("generation").alias("__live"))
        tables[name] = rows.join(live, "document").where(F.col("generation") == F.col("__live")).drop("generation", "__live")
    updated = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated"))
    return Corpus(tables["parents"], tables["children"], tables["number_index"], versions.select("file", "sha256"), updated)


def _append(arrivals: DataFrame, generation: int, store: str, catalog_path: str | None, strict: bool, dictionary: Dictionary) -> None:
    spark = arrivals.sparkSession
    named = arrivals.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "path", "modificationTime", F.sha2("content", 256).alias("sha256"))
    # Of several arrivals of one file in a batch the latest counts. Contents stay out of the shuffle.
    latest = Window.partitionBy("file").orderBy(F.desc("modificationTime"), F.desc("path"))
    changed = cut_lineage(
        named.withColumn("__turn", F.row_number().over(latest)).where("__turn = 1")
        .join(manifest(spark, store, generation).select("file", "sha256"), ["file", "sha256"], "left_anti").select("path", "file", "sha256"))
    if changed.isEmpty():
        return
    files = arrivals.select("path", "content").join(changed, "path").select("file", "sha256", "content")
    pages = cut_lineage(S.with_metadata(S.markdown_pages(files), S.read_catalog(spark, catalog_path)))
    good = cut_lineage(changed.join(pages.select(F.col("document").alias("file")).distinct(), "file", "left_semi").select("file", "sha256"))
    unread = S.unreadable_files(files).withColumn("reason", F.lit(NOT_UTF8))
    bad = changed.join(good, "file", "left_anti").join(unread, "file", "left").select("file", F.coalesce("reason", F.lit(NO_PAGES)).alias("reason"), "sha256")
    corpus = corpus_from_pages(pages, good, strict, dictionary)

    def write(rows: DataFrame, table: str) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/{table}/generation={generation}")

    write(bad, "skipped")
    for table in TABLES:
        write(getattr(corpus, table), table)
    write(good, "manifest")  # last: rows count once their manifest is there


def refresh(spark: SparkSession, arrivals: str, store: str, checkpoint: str, catalog_path: str | None = None, files_per_batch: int = 10_000,
            strict: bool = False, dictionary: Dictionary = DEFAULT_DICTIONARY) -> None:
    """Take up every Markdown file that has arrived below ``arrivals`` since the last call, then return.

    Files are known by name, wherever they lie: a new version arrives under a new path (one folder a delivery, say), as a
    stream takes up each path once. A version that can't be read, or has no text, leaves the stored one in place and is
    listed in ``skipped``. ``checkpoint`` keeps the stream's progress and belongs to one store.
    """
    stream = (
        spark.readStream.format("binaryFile").schema(ARRIVAL).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(arrivals))
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, generation: _append(rows, generation, store, catalog_path, strict, dictionary)).start()
    query.awaitTermination()
