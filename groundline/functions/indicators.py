"""Indicator matching and question expansion as in-row expressions (no join, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions.text import let, strip, table

MAX_INDICATORS = 3
MAX_VARIANTS = 5
SYNONYMS_PER_INDICATOR = 2


def _alias_pattern(aliases) -> str:
    return r"(?Ui)\b(?:" + "|".join(rf"\Q{a}\E" for a in aliases) + r")\b"


def contains_alias(text: Column, alias: str) -> Column:
    """Whole-word alias test without case."""
    return text.rlike(_alias_pattern([alias]))


def indicator_of(label: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """First indicator, in dictionary order, that a label or passage names; NULL when none."""
    # One test for "any alias at all" spares most passages the per-indicator tests.
    everything = _alias_pattern([a for _, aliases in dictionary.indicators for a in aliases])
    chain = F.lit(None).cast("string")
    for canon, aliases in reversed(dictionary.indicators):
        chain = F.when(label.rlike(_alias_pattern(aliases)), F.lit(canon)).otherwise(chain)
    return F.when(label.rlike(everything), chain)


def matched_indicators(text: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """Indicators named in a text, longest canonical name first, at most three."""
    ordered = sorted(dictionary.indicators, key=lambda spec: -len(spec[0]))
    hits = [F.when(text.rlike(_alias_pattern(aliases)), F.lit(canon)) for canon, aliases in ordered]
    return F.slice(F.array_compact(F.array(*hits)), 1, MAX_INDICATORS)


def _distinct_ignoring_case(variants: Column) -> Column:
    return let(F.transform(variants, F.lower), lambda lowered: F.filter(
        variants, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1))


def _wordings(q: Column, dictionary: Dictionary) -> Column:
    synonyms = table({canon: aliases[:SYNONYMS_PER_INDICATOR] for canon, aliases in dictionary.indicators},
                     "map<string,array<string>>")
    pairs = "array<struct<term:string,text:string>>"
    rows = lambda data: table([{"term": term, "text": text} for term, text in data], pairs)
    low = F.lower(q)

    def named(data) -> Column:
        return F.transform(F.filter(rows(data), lambda r: F.contains(low, r["term"])), lambda r: r["text"])

    by_indicator = F.flatten(F.transform(matched_indicators(q, dictionary), lambda canon: F.transform(
        synonyms[canon], lambda s: F.concat(q, F.lit(" ("), s, F.lit(")")))))
    bilingual = let(named(dictionary.cross_lingual), lambda terms: F.when(
        F.size(terms) > 0, F.array(F.concat(q, F.lit(" "), F.array_join(terms, " ")))
    ).otherwise(F.array().cast("array<string>")))
    aspects = F.transform(named(dictionary.aspects), lambda d: F.concat(q, F.lit(": detalle de "), d))
    return F.concat(F.array(q), by_indicator, bilingual, aspects)


def expand_question(question: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """Variants of a question: itself, synonyms, one bilingual form, broad aspects; at most five."""
    def expand(q: Column) -> Column:
        variants = let(_wordings(q, dictionary), _distinct_ignoring_case)
        return F.when(q == "", F.array().cast("array<string>")).otherwise(F.slice(variants, 1, MAX_VARIANTS))

    return let(strip(question), expand)
