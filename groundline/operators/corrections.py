"""Sourced corrections for figures that are not grounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions import numeric as N
from groundline.operators.grounding import CURRENCY, IN_CORPUS, NOTATION, UNKNOWN
from groundline.operators.number_index import first_locations
from groundline.session import broadcast_if_small, cut_lineage, has_copies, prune_scan, stored

AMOUNT = ["currency", "value", "base_digits"]
CORRECTION = ["kind", "hallucinated", "suggested_value", "source", "snippet"]


def wanted_numbers(verdicts: DataFrame) -> DataFrame:
    """Distinct numbers that the corrections of ``verdicts`` look up."""
    money = F.flatten(F.transform("hallucinated_money", lambda m: F.array(m["value"], m["base_digits"])))
    return verdicts.select(F.explode(F.concat(money, F.col("hallucinated_numbers"))).alias("number")).distinct()


def amounts_in_snippets(index: DataFrame) -> DataFrame:
    """(number, value, currency, document, page, pos, snippet): first snippet per number and amount.

    One row per distinct (number, amount) whatever the number's spread, merged before the shuffle.
    """
    hits = index.select("number", "document", "page", "snippet",
                        F.posexplode_outer(N.money_phrases(F.col("snippet"))).alias("pos", "m")).where("pos IS NOT NULL")
    first = F.min(F.struct("document", "page", "pos", "snippet")).alias("at")
    return hits.groupBy("number", F.col("m.value").alias("value"), F.col("m.currency").alias("currency")).agg(
        first).select("number", "value", "currency", "at.*")


def look_up_amounts(money: DataFrame, found: DataFrame, places: DataFrame) -> DataFrame:
    """(currency, value, base_digits, alt, loc) of money(m): for each different amount the first place that writes it with another
    currency, and the first that holds its digits. Amounts without either are left out."""
    looked = money.select("m.currency", "m.value", "m.base_digits").distinct().select(
        *AMOUNT, F.posexplode(F.array("value", "base_digits")).alias("prio", "number"))
    other = amounts_in_snippets(found).select(
        "number", F.col("value").alias("alt_value"), F.col("currency").alias("alt_currency"),
        *[F.col(c).alias(f"alt_{c}") for c in ("document", "page", "pos", "snippet")])
    # Number and amount are both join keys: a number on many pages meets only its equal amounts.
    swapped = looked.withColumn("alt_value", F.col("value")).join(other, ["number", "alt_value"]).where(
        F.col("alt_currency") != F.col("currency")).groupBy(*AMOUNT).agg(F.min(F.struct(
            "prio", "alt_document", "alt_page", "alt_pos", "alt_currency", "alt_value", "alt_snippet")).alias("alt"))
    located = looked.join(places, "number").groupBy(*AMOUNT).agg(
        F.min(F.struct("prio", "document", "page", "snippet")).alias("loc"))
    return swapped.unionByName(located, allowMissingColumns=True).groupBy(*AMOUNT).agg(
        F.min("alt").alias("alt"), F.min("loc").alias("loc"))


def find_corrections(verdicts: DataFrame, by: list[str], index: DataFrame | None = None,
                     context: str = "context") -> DataFrame:
    """(by, ord, kind, hallucinated, suggested_value, source, snippet) for every ungrounded figure.

    Amounts come first, then numbers, then percentages. An amount that the corpus writes with
    another currency suggests that one; one that is only written differently points to its page.
    ``index`` is (number, document, page, snippet); None looks up nothing.
    """
    spark = verdicts.sparkSession
    if index is None:
        index = spark.createDataFrame([], "number string, document string, page long, snippet string")
    # Small from here on: ungrounded figures only, and the index rows they ask for.
    # (Filtering before the cut would make Spark evaluate the verdict once more for the filter.)
    some = F.size("hallucinated_numbers") > 0
    verdicts = stored(verdicts.select(
        *by, "hallucinated_money", "hallucinated_percent", "hallucinated_numbers",
        F.when(some, F.array_intersect("hallucinated_numbers", N.raw_numbers(F.col(context)))).alias("here")), "verdicts")
    wanted = cut_lineage(wanted_numbers(verdicts))
    found = stored(prune_scan(index, "number", wanted).join(
        broadcast_if_small(wanted), "number", "left_semi"), "found")
    places = broadcast_if_small(stored(first_locations(found), "places"))
    page = lambda doc, p: F.format_string("%s pág. %d", doc, p)

    money = verdicts.select(*by, F.posexplode("hallucinated_money").alias("ord", "m"))
    looked_up = broadcast_if_small(stored(look_up_amounts(money.select("m"), found, places), "amounts"))
    same = F.lit(True)
    for c in AMOUNT:
        same &= F.col("m")[c].eqNullSafe(looked_up[c])
    of_money = money.join(looked_up, same, "left").select(
        *by, F.lit(0).alias("group"), "ord",
        F.when(F.col("alt").isNotNull(), CURRENCY).when(F.col("loc").isNotNull(), NOTATION)
        .otherwise(UNKNOWN).alias("kind"),
        N.money_key(F.col("m")).alias("hallucinated"),
        F.when(F.col("alt").isNotNull(), F.concat("alt.alt_currency", F.lit("|"), "alt.alt_value"))
        .otherwise(F.col("loc.snippet")).alias("suggested_value"),
        F.when(F.col("alt").isNotNull(), page("alt.alt_document", "alt.alt_page"))
        .when(F.col("loc").isNotNull(), page("loc.document", "loc.page")).alias("source"),
        F.coalesce("alt.alt_snippet", "loc.snippet").alias("snippet"),
    )

    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    numbers = verdicts.select(*by, "here", size("hallucinated_money").alias("before"),
                              F.posexplode(F.array_sort("hallucinated_numbers")).alias("ord", "number"))
    of_numbers = numbers.withColumn("here", F.array_contains("here", F.col("number"))).join(places, "number", "left").select(
        *by, F.lit(1).alias("group"), (F.col("before") + F.col("ord")).alias("ord"),
        F.when(F.col("here") | F.col("document").isNotNull(), IN_CORPUS).otherwise(UNKNOWN).alias("kind"),
        F.col("number").alias("hallucinated"), F.lit(None).cast("string").alias("suggested_value"),
        F.when(~F.col("here") & F.col("document").isNotNull(), page("document", "page")).alias("source"),
        F.when(~F.col("here"), F.col("snippet")).alias("snippet"),
    )

    before = size("hallucinated_money") + size("hallucinated_numbers")
    of_percent = verdicts.select(*by, before.alias("before"), F.posexplode("hallucinated_percent").alias("ord", "p")).select(
        *by, F.lit(2).alias("group"), (F.col("before") + F.col("ord")).alias("ord"), F.lit(UNKNOWN).alias("kind"),
        F.col("p.canon").alias("hallucinated"), F.lit(None).cast("string").alias("suggested_value"),
        F.lit(None).cast("string").alias("source"), F.col("p.raw_text").alias("snippet"))

    together = of_money.unionByName(of_numbers).unionByName(of_percent)
    if has_copies(verdicts, by):
        # the figures of several answers with one key are numbered as those of one
        position = F.row_number().over(Window.partitionBy(*by).orderBy("group", "ord")) - 1
        together = together.withColumn("ord", position)
    return together.select(*by, "ord", *CORRECTION)
