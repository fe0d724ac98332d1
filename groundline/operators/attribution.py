"""Does an amount belong to the issuer and indicator a sentence speaks of?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions import numeric as N
from groundline.functions import text as T
from groundline.functions.indicators import matched_indicators

TOTAL_WORDS = ("total", "totales")


def mentions_total(lowered: Column) -> Column:
    return T.has_word(lowered, TOTAL_WORDS[0]) | T.has_word(lowered, TOTAL_WORDS[1])


def issuer_of_sentence(lowered: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """First issuer, in list order, that a sentence names."""
    chain = F.lit(None).cast("string")
    for canon, names in reversed(dictionary.answer_issuers):
        pattern = "|".join(rf"\Q{n}\E" for n in names)
        chain = F.when(
            lowered.rlike(rf"(?<![0-9A-Za-z])(?:{pattern})(?![0-9A-Za-z])"), F.lit(canon)).otherwise(chain)
    return chain


def pair_amounts(children: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(issuer, indicator, amount, in_segment): the amounts the corpus gives for each pair.

    ``in_segment`` says that some chunk with the amount speaks of a business segment and of no
    total. Merged before the shuffle, so a pair with many chunks moves only its distinct amounts.
    """
    low = F.lower("content")
    qualifier = "|".join(rf"\Q{q}\E" for q in dictionary.segment_qualifiers)
    names = F.split(F.lit("\t".join(canon for canon, _ in dictionary.answer_issuers)), "\t")
    written = F.lower("issuer")
    owners = F.filter(names, lambda n: F.contains(written, F.lower(n)))
    return (
        children.where("indicator IS NOT NULL")
        .select("indicator", owners.alias("owners"), N.money_phrases(F.col("content")).alias("money"),
                (low.rlike(qualifier) & ~mentions_total(low)).alias("in_segment"))
        .select("owners", "indicator", F.explode_outer("money").alias("m"), "in_segment")
        .where("m IS NOT NULL")
        .select(F.explode("owners").alias("issuer"), "indicator", "m", "in_segment")
        .groupBy("issuer", "indicator", N.money_key(F.col("m")).alias("amount"))
        .agg(F.max("in_segment").alias("in_segment"))
    )


def claims(responses: DataFrame, by: list[str], response: str = "response",
           dictionary: Dictionary = DEFAULT_DICTIONARY, strict: bool = False) -> DataFrame:
    """(by, s_idx, m_idx, issuer, indicator, currency, value, amount, says_total) of every answer."""
    sentences = responses.select(
        *by, F.posexplode_outer(T.sentences(F.col(response), strict)).alias("s_idx", "sentence")
    ).where("s_idx IS NOT NULL")
    low = F.lower("sentence")
    placed = sentences.select(
        *by, "s_idx", issuer_of_sentence(low, dictionary).alias("issuer"),
        F.get(matched_indicators(F.col("sentence"), dictionary), F.lit(0)).alias("indicator"),
        N.money_phrases(F.col("sentence")).alias("money"), mentions_total(low).alias("says_total"),
    ).where("issuer IS NOT NULL AND indicator IS NOT NULL")
    return placed.select(
        *by, "s_idx", "issuer", "indicator", "says_total", F.posexplode_outer("money").alias("m_idx", "m")
    ).where("m IS NOT NULL").select(*by, "s_idx", "m_idx", "issuer", "indicator", F.col("m.currency").alias("claimed_currency"),
             F.col("m.value").alias("claimed_value"), N.money_key(F.col("m")).alias("amount"), "says_total")


FINDING = ["indicator", "issuer", "claimed_currency", "claimed_value", "correct_value", "segment_qualifier",
           "is_misattribution"]


def findings(stated: DataFrame, amounts: DataFrame, by: list[str]) -> DataFrame:
    """Claims whose amount the corpus lacks for the pair, or has only for a segment of a total."""
    only = amounts.groupBy("issuer", "indicator").agg(
        F.count(F.lit(1)).alias("n"), F.min("amount").alias("amount")
    ).select("issuer", "indicator", F.when(F.col("n") == 1, F.col("amount")).alias("correct_value"))
    # One row for each pair of the dictionary's issuers and indicators, so the broadcast is bounded by the dictionary.
    known = stated.join(amounts, ["issuer", "indicator", "amount"], "left").join(
        F.broadcast(only), ["issuer", "indicator"], "left")
    wrong = F.col("in_segment").isNull()
    judged = known.withColumn("is_misattribution", wrong).withColumn(
        "segment_qualifier", ~wrong & F.col("says_total") & F.coalesce("in_segment", F.lit(False)))
    return judged.where("is_misattribution OR segment_qualifier").select(*by, "s_idx", "m_idx", *FINDING)
