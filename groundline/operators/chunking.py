"""Pages to parent chunks to child chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions import text as T
from groundline.functions.indicators import indicator_of

PARENT_CHARS, PARENT_OVERLAP = 2000, 200
CHILD_CHARS, CHILD_OVERLAP = 400, 50

# Fixed value: the separator line written under the header of every table row chunk.
TABLE_RULE = "|---|---|---|"
# Preferred cuts, best first.
_CUTS = ("\n\n", "\n", ". ", " ")


def _windows(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping windows of one text, each cut after its last preferred separator."""
    if len(text) <= size:
        return [text]
    chunks, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in _CUTS:
                at = text.rfind(mark, start, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        piece = text[start:end].strip()
        if piece:
            chunks.append(piece)
        if end >= len(text):
            break
        start = end - overlap if end > start + overlap else end
    return chunks


def split_text(c: Column, size: int, overlap: int) -> Column:
    """Recursive splitter as array<string>. Each cut depends on the one before, hence Arrow.

    Give the result a column of its own before exploding it; it is marked so that Spark keeps it there.
    """

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else _windows(t, size, overlap))

    return cut.asNondeterministic()(c)


def table_rows(c: Column, title: Column) -> Column:
    """Table row chunks of a text: array<struct<content, label>>; no data rows gives the whole text.

    Rows before the first ``---`` row are the header, repeated in front of every data row.
    """
    whole = F.array(F.struct(c.alias("content"), F.lit("").alias("label")))

    def split(rows: Column) -> Column:
        rule_at = F.coalesce(
            F.nullif(F.array_position(F.transform(rows, lambda r: r.contains("---")), True), F.lit(0)) - 1,
            F.size(rows))
        return T.let(rule_at, lambda at: build(
            F.array_join(F.filter(rows, lambda r, i: i < at), "\n"), F.filter(rows, lambda r, i: i > at)))

    def build(header: Column, data: Column) -> Column:
        prefix = F.concat(
            F.when(title == "", F.lit("")).otherwise(F.concat(title, F.lit("\n"))),
            F.when(header == "", F.lit("")).otherwise(F.concat(header, F.lit(f"\n{TABLE_RULE}\n"))),
        )
        chunks = T.let(prefix, lambda p: F.transform(data, lambda row: chunk(p, row)))
        return F.when(F.size(data) > 0, chunks).otherwise(whole)

    def chunk(prefix: Column, row: Column) -> Column:
        cells = F.filter(F.transform(F.split(row, r"\|"), T.strip), lambda s: s != "")
        label = F.coalesce(F.get(cells, F.lit(0)), F.lit(""))
        return F.struct(F.concat(prefix, row).alias("content"), label.alias("label"))

    return T.let(T.pipe_rows(c), split)


def _prose(c: Column) -> Column:
    """The text without its table rows, for chunks that mix a table with prose."""
    kept = F.filter(T.lines(c), lambda s: ~T.strip(s).rlike(r"(?d)^\|.*\|$"))
    return T.strip(F.array_join(kept, "\n"))


META = ["document", "page", "issuer", "doc_type", "year", "title"]


def parent_chunks(pages: DataFrame, size: int = PARENT_CHARS, overlap: int = PARENT_OVERLAP,
                  dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """One row per parent chunk. Narrow: every page is cut where it lies."""
    cut = pages.withColumn("__parts", split_text(F.col("text"), size, overlap)).select(
        *META, F.posexplode("__parts").alias("p_idx", "content"))
    return cut.withColumn(
        "parent_id", F.format_string("%s_p%d_parent_%d", "document", "page", "p_idx")
    ).withColumn("is_toc", T.is_contents_page(F.col("content"), dictionary))


def child_chunks(parents: DataFrame, size: int = CHILD_CHARS, overlap: int = CHILD_OVERLAP,
                 strict: bool = False, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """One row per child chunk: table rows one by one, prose by the splitter.

    A parent that holds a table and prose gives both kinds; ``strict`` keeps only its table rows.
    """
    content = F.col("content")
    table = T.is_pipe_table(content)
    rows = table_rows(content, F.col("title"))
    prose = F.when(~F.col("__table"), content)
    if not strict:
        has_rows = F.exists("__rows", lambda r: r["label"] != "")
        prose = prose.otherwise(F.when(has_rows & (_prose(content) != ""), _prose(content)))
    part = "array<struct<is_table:boolean,content:string,label:string>>"
    row_parts = F.transform("__rows", lambda r: F.struct(
        F.lit(True).alias("is_table"), r["content"].alias("content"), r["label"].alias("label"))).cast(part)
    prose_part = F.array(F.struct(
        F.lit(False).alias("is_table"), F.col("__prose").alias("content"), F.lit("").alias("label"))).cast(part)
    empty = F.array().cast(part)
    parts = F.concat(F.coalesce(row_parts, empty), F.when(F.col("__prose").isNotNull(), prose_part).otherwise(empty))
    keys = [*META, "parent_id", "p_idx", "is_toc"]
    exploded = (
        parents.withColumn("__table", table).withColumn("__rows", F.when(F.col("__table"), rows))
        .withColumn("__prose", prose).select(*keys, F.posexplode(parts).alias("k", "part"))
    )
    # Only prose goes through the splitter; a table row is its own piece.
    is_table = F.col("part.is_table")
    pieces = exploded.withColumn(
        "cuts", split_text(F.when(~is_table, F.col("part.content")), size, overlap)
    ).select(*keys, "k", "part", F.posexplode(
        F.coalesce("cuts", F.array("part.content"))).alias("j", "content"))
    number = F.when(is_table, F.concat(F.lit("_child_t_"), F.col("k").cast("string"))).otherwise(
        F.concat(F.lit("_child_"), F.col("j").cast("string")))
    label = F.when(is_table, F.col("part.label")).otherwise(F.col("content"))
    return pieces.select(
        F.concat("parent_id", number).alias("child_id"), "parent_id", *META, "p_idx",
        (F.col("k") + F.col("j")).alias("c_idx"), "is_toc", "content", is_table.alias("is_table"),
        indicator_of(label, dictionary).alias("indicator"),
    )


def with_child_ids(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with their ordered child ids; a parent's children are bounded by its own text."""
    ids = children.groupBy("parent_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c_idx", "child_id"))), lambda s: s["child_id"])
        .alias("child_ids")
    )
    return parents.join(ids, "parent_id", "left")
