"""Numbers, amounts, percentages and years in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.functions.text import let, strip, table

# ---- Fixed values: number grammar ----
INDEX_NUMBER = (
    r"(?Ui)\b(?:\d{1,3}(?:[.,'\s’]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?:%|[xXmMkK]|MM|mm)?\b"
)
RAW_NUMBER = r"(?U)\b\d[\d.,'’]*[xXmMkK%]?\b"
# A first look at one character spares most places of a text the alternatives; a run of digits is taken whole.
MONEY = (
    r"(?=[uUpPsSſ$])(?Ui)(us\s*\$|usd|pen|s\s*/\.?|\$)\s*\.?\s*(\d[\d.,'’]*)"
    r"(?:\s*(mil millones|billones|billón|billon|millones|millón|millon|million|miles|mil|billion))?"
)
PERCENT = r"(?Ui)(\d[\d.,'’]*+)\s*(?:%|percent|por ciento)"
YEAR = r"(?=[12])(?U)\b(?:19|20|21)\d{2}\b"
# Zeros that a multiplier word appends.
MULTIPLIER_ZEROS = {
    "mil millones": 9,
    "billones": 12, "billón": 12, "billon": 12,
    "millones": 6, "millón": 6, "millon": 6, "million": 6,
    "miles": 3, "mil": 3,
    "billion": 9,
}
# Amounts saturate at the largest unsigned 128-bit integer.
MAX_AMOUNT = str(2**128 - 1)
CURRENCY_KEYS = {"$": "usd", "us$": "usd", "usd": "usd", "us": "usd",
                 "s/": "pen", "s/.": "pen", "s": "pen", "pen": "pen"}
SNIPPET_CHARS = 60

MONEY_TYPE = "array<struct<currency:string,base_digits:string,value:string,raw_text:string>>"
PERCENT_TYPE = "array<struct<canon:string,base_digits:string,raw_text:string>>"


def _find(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches; texts without any digit skip the pattern."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.when(c.rlike(r"\p{Nd}"), found).otherwise(F.array().cast("array<string>"))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def normalize_number(c: Column) -> Column:
    """Digits of a number token, or NULL when something other than number marks is left."""
    digits = lambda s: s.rlike("^[0-9]+$")
    bare = let(strip(F.regexp_replace(c, r"S/|[,. %$’'xXmMkKbB]", "")), lambda s: F.when(digits(s), s))
    return F.when(digits(c), strip(c)).otherwise(bare)


def index_tokens(c: Column) -> Column:
    """Number tokens as the number index sees them."""
    return _find(c, INDEX_NUMBER)


def index_numbers(c: Column) -> Column:
    """Distinct normalised index numbers."""
    return F.array_distinct(F.filter(F.transform(index_tokens(c), normalize_number), lambda x: x.isNotNull()))


def located_numbers(c: Column, window: int = SNIPPET_CHARS) -> Column:
    """Index tokens with the text around them: array<struct<token, snippet>> in text order.

    The text is cut at its tokens. A token has one character at least, so the ``window`` tokens and gaps next to a token hold
    all of its context, and of a long gap only its two ends matter: the work grows with the text, whatever the number of tokens.
    """
    ends = lambda gap: F.when(F.length(gap) > 2 * window, F.concat(F.left(gap, F.lit(window)), F.right(gap, F.lit(window)))).otherwise(gap)
    text = F.coalesce(c, F.lit(""))
    gaps = F.transform(F.split(text, INDEX_NUMBER, -1), ends)
    # gap, token, gap, ..., token, gap, and an empty token after the last gap
    pieces = F.flatten(F.zip_with(gaps, F.concat(index_tokens(text), F.array(F.lit(""))), lambda gap, token: F.array(gap, token)))

    def describe(cut: Column, i: Column) -> Column:
        at, near = 2 * i + 2, 2 * window  # the token's place from 1
        first = F.greatest(at - near, F.lit(1))
        left = F.substring(F.array_join(F.slice(cut, first, at - first), ""), -window, window)
        right = F.substring(F.array_join(F.slice(cut, at + 1, near), ""), 1, window)
        token = F.get(cut, at - 1)
        return F.struct(token.alias("token"), strip(F.replace(F.concat(left, token, right), F.lit("\n"), F.lit(" "))).alias("snippet"))

    # as many turns as tokens
    return let(pieces, lambda cut: F.transform(F.slice(cut, 1, (F.size(cut) / 2 - 1).cast("int")), lambda _, i: describe(cut, i)))


def raw_numbers(c: Column) -> Column:
    """Distinct digits of complete number tokens (32.2 gives 322, never 32)."""
    digits = F.transform(_find(c, RAW_NUMBER), digits_only)
    return F.array_distinct(F.filter(digits, lambda d: d != ""))


def years(c: Column) -> Column:
    return F.array_distinct(_find(c, YEAR))


def is_year(c: Column) -> Column:
    return c.rlike(r"^(?:19|20|21)[\s\S]{2}$") & (F.octet_length(c) == 4)


def currency_key(c: Column) -> Column:
    keys = table(CURRENCY_KEYS, "map<string,string>")
    return let(F.regexp_replace(F.lower(c), r"(?U)\s", ""), lambda tight: F.coalesce(keys[tight], tight))


def _zeros(word: Column) -> Column:
    zeros = table({name: "0" * count for name, count in MULTIPLIER_ZEROS.items()}, "map<string,string>")
    return F.coalesce(zeros[F.lower(word)], F.lit(""))


def _fits(digits: Column) -> Column:
    size = F.length(digits)
    return (size < len(MAX_AMOUNT)) | ((size == len(MAX_AMOUNT)) & (digits <= MAX_AMOUNT))


def amount(digits: Column, multiplier: Column) -> Column:
    """Digits times a multiplier word by appending zeros; NULL when the digits alone overflow."""
    def scale(base: Column) -> Column:
        scaled = F.when(base == "0", base).otherwise(F.concat(base, _zeros(multiplier)))
        capped = let(scaled, lambda v: F.when(_fits(v), v).otherwise(F.lit(MAX_AMOUNT)))
        return F.when(_fits(base), capped)

    return let(F.regexp_replace(digits, "^0+(?=[0-9])", ""), scale)


def money_phrases(c: Column) -> Column:
    """Amounts with a currency sign, in text order: currency, base_digits, value, raw_text."""
    # The pattern looks at nothing outside a match, so a match's parts are those of the match alone: the text is read once.
    def parse(raw: Column) -> Column:
        part = lambda g: F.regexp_extract(raw, MONEY, g)
        return let(digits_only(part(2)), lambda digits: F.struct(
            currency_key(part(1)).alias("currency"),
            digits.alias("base_digits"),
            amount(digits, part(3)).alias("value"),
            raw.alias("raw_text"),
        ))

    parsed = F.transform(_find(c, MONEY), parse)
    return F.filter(parsed, lambda m: (m["base_digits"] != "") & m["value"].isNotNull()).cast(MONEY_TYPE)


def percent_phrases(c: Column) -> Column:
    """Percentages, written as a sign or in words: canon, base_digits, raw_text."""
    def parse(raw: Column) -> Column:
        return let(digits_only(raw), lambda digits: F.struct(
            F.concat(F.lit("%|"), digits).alias("canon"), digits.alias("base_digits"), raw.alias("raw_text")))

    return F.filter(F.transform(_find(c, PERCENT), parse), lambda p: p["base_digits"] != "").cast(PERCENT_TYPE)


def money_key(m: Column) -> Column:
    return F.concat(m["currency"], F.lit("|"), m["value"])
