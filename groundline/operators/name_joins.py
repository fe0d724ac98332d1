"""Dictionaries and names of any size met by equi-joins instead of one pattern for each entry or a comparison of all pairs.

Whole-word aliases: an alias is a run of words, so a text names it only where the text's n-gram of that length is the same run.
Containment of names: a name lies in another one only if the other has the name's rarest piece of ``q`` characters. Both joins
produce candidates, which the exact test then judges, so results are those of the nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions import text as T
from groundline.session import broadcast_if_small, cut_lineage

WORD = r"(?U)\w+"
PIECE = 3


def word_run(c: Column) -> Column:
    """Words of a text, folded at least as far as matching without case folds them."""
    return F.regexp_extract_all(F.lower(F.upper(F.translate(c, "İı", "Ii"))), F.lit(WORD), F.lit(0))


def _grams(words: Column, n: int) -> Column:
    """Runs of ``n`` words at every place of a text."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))


# An alias whose words and gaps are compared as they are: ASCII, and a word character at both ends.
PLAIN = r"^[A-Za-z0-9_]([\x00-\x7F]*[A-Za-z0-9_])?\z"


def _folded(c: Column) -> Column:
    """Lower case; the four other characters that match an ASCII letter without case become that letter."""
    return F.lower(F.translate(c, "İıſ\u212a", "iisk"))


def _plain_runs(text: Column, lengths: list[int]) -> Column:
    """Distinct runs of words of a text with the gaps between them as they are written."""
    def runs(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
        gaps = F.slice(F.split(low, WORD), F.lit(2), F.greatest(F.size(words), F.lit(1)))
        return T.let(words, lambda w: T.let(F.flatten(F.zip_with(w, gaps, lambda x, g: F.array(x, g))), lambda both: F.array_distinct(
            F.flatten(F.array(*[F.transform(F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: i <= F.size(w) - n),
                                            lambda i: F.array_join(F.slice(both, 2 * i + 1, F.lit(2 * n - 1)), "")) for n in lengths])))))

    return T.let(_folded(text), runs)


def alias_matches(texts: DataFrame, aliases: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, canon, alias, ord) for every alias that a text names as whole words without case.

    ``aliases`` is (canon, alias, ord); ``ord`` is the dictionary's order. Same hits as the pattern ``\\bALIAS\\b``. Null texts and
    null aliases match nothing, nor does an alias without a letter or digit. Each text meets only the dictionary's entries whose words it
    holds. Texts with one id count as one row for each of them; equal aliases of several canons all count. ``by`` tells texts apart.
    ASCII aliases that begin and end in a word are found by the join alone; others are tested by their pattern.
    """
    words = word_run(F.col("alias"))
    entries = aliases.where("alias IS NOT NULL").select(
        "canon", "alias", "ord", F.array_join(words, " ").alias("gram"), F.size(words).alias("n"), F.rlike("alias", F.lit(PLAIN)).alias("plain"))
    entries = cut_lineage(entries.where("n > 0"))
    source = texts.select(F.col(by).alias("__by"), F.col(text).alias("__text"))
    found = _by_pattern(source, entries.where("NOT plain"))
    # one for each length in words
    lengths = sorted(r["n"] for r in entries.where("plain").select("n").distinct().collect())
    if lengths:
        known = entries.where("plain").groupBy(F.lower("alias").alias("run")).agg(F.collect_set(F.struct("canon", "alias", "ord")).alias("found"))
        runs = source.where("__by IS NOT NULL").select("__by", F.explode(_plain_runs(F.col("__text"), lengths)).alias("run"))
        found = runs.join(broadcast_if_small(cut_lineage(known)), "run").select("__by", F.explode("found").alias("e")).select("__by", "e.*").unionByName(found)
    return found.select(F.col("__by").alias(by), "canon", "alias", "ord")


def _by_pattern(source: DataFrame, entries: DataFrame) -> DataFrame:
    """(__by, canon, alias, ord): texts meet entries by their runs of words, the pattern judges."""
    lengths = sorted(r["n"] for r in entries.select("n").distinct().collect())
    if not lengths:
        return source.join(entries, F.lit(False)).select("__by", "canon", "alias", "ord")
    held = T.let(word_run(F.col("__text")), lambda w: F.array_distinct(F.flatten(F.array(*[_grams(w, n) for n in lengths]))))
    # The dictionary's runs come to the n-grams where it is small; else both move by run, and frequent runs are few rows of text ids.
    runs = broadcast_if_small(entries.select("gram").distinct())
    hits = source.select("__by", F.explode(held).alias("gram")).join(runs, "gram", "left_semi").distinct()
    found = hits.join(broadcast_if_small(entries), "gram").groupBy("__by").agg(F.collect_set(F.struct("canon", "alias", "ord")).alias("found"))
    named = source.join(found, "__by").withColumn("found", F.explode("found")).select("__by", "__text", "found.*")
    exact = F.rlike("__text", F.concat(F.lit(r"(?Ui)\b"), F.regexp_replace("alias", r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b")))
    return named.where(exact).select("__by", "canon", "alias", "ord")


def first_canon(matches: DataFrame, by: str) -> DataFrame:
    """(by, canon, alias): of a text's matches the first in dictionary order, ties by alias."""
    first = F.min(F.struct("ord", "alias", "canon")).alias("first")
    return matches.groupBy(by).agg(first).select(by, "first.canon", "first.alias")


def _pieces(c: Column, sizes: list[int]) -> Column:
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def _held_in(needles: DataFrame, hay: DataFrame, q: int) -> DataFrame:
    """(needle, hay): every distinct needle that lies in a distinct hay."""
    size = F.least(F.length("needle"), F.lit(q))
    sizes = sorted(r["n"] for r in needles.select(size.alias("n")).distinct().collect())  # q at most
    if not sizes:
        return needles.join(hay, F.lit(False))
    pieces = hay.select("hay", F.explode(_pieces(F.col("hay"), sizes)).alias("piece"))
    spread = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("spread"))
    own = needles.select("needle", F.explode(_pieces(F.col("needle"), sizes)).alias("piece"), size.alias("n")).where(F.length("piece") == F.col("n"))
    # A piece that no hay has proves that the needle lies nowhere.
    rarest = own.join(spread, "piece", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("spread", F.lit(0)).alias("spread"), "piece")).alias("r")).where("r.spread > 0").select("needle", "r.piece")
    return rarest.join(pieces, "piece").where(F.contains("hay", F.col("needle"))).select("needle", "hay")


def contained_names(left: DataFrame, right: DataFrame, q: int = PIECE) -> DataFrame:
    """(left_name, right_name, direction) of the distinct ``name`` values of two tables, where one lies in the other.

    ``direction`` is 'in' (left in right), 'holds' (right in left) or 'equal'. Null and empty names take no part: an empty name
    lies in every other one, which callers treat on its own. Repeated names count once; ids join back by name.
    """
    a = cut_lineage(left.select("name").where("name <> ''").distinct())
    b = cut_lineage(right.select("name").where("name <> ''").distinct())
    inside = _held_in(a.select(F.col("name").alias("needle")), b.select(F.col("name").alias("hay")), q).select(
        F.col("needle").alias("left_name"), F.col("hay").alias("right_name"))
    holding = _held_in(b.select(F.col("name").alias("needle")), a.select(F.col("name").alias("hay")), q).select(
        F.col("hay").alias("left_name"), F.col("needle").alias("right_name"))
    same = F.col("left_name") == F.col("right_name")
    return inside.withColumn("direction", F.when(same, F.lit("equal")).otherwise(F.lit("in"))).unionByName(
        holding.where(~same).withColumn("direction", F.lit("holds")))
