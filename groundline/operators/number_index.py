"""Inverted number index: where each number is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.functions import numeric as N


def number_index(pages: DataFrame) -> DataFrame:
    """(number, document, page, snippet): the first mention of a number on each page.

    Duplicates are merged before the shuffle, so a number written on every page moves one row
    per page and no group is ever gathered.
    """
    # The outer form keeps Spark from evaluating the pattern a second time in a filter.
    mentions = pages.select(
        "document", "page", F.posexplode_outer(N.located_numbers(F.col("text"))).alias("pos", "hit")
    ).where("pos IS NOT NULL").select(
        N.normalize_number(F.col("hit.token")).alias("number"), "document", "page", "pos",
        F.col("hit.snippet").alias("snippet"),
    ).where("number IS NOT NULL")
    return mentions.groupBy("number", "document", "page").agg(F.min_by("snippet", "pos").alias("snippet"))


def first_locations(index: DataFrame) -> DataFrame:
    """First place of every number in (document, page) order."""
    return index.groupBy("number").agg(F.min(F.struct("document", "page", "snippet")).alias("loc")).select(
        "number", "loc.*"
    )
