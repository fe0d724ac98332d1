"""Questions to sub-queries, variants and weighted search terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions import text as T
from groundline.functions.indicators import expand_question

# Rare words of a question count three times.
RARE_WORDS = 3
RARE_IDF = 3.0
RARE_REPEAT = 3
SISTER_BOOST = 1.5


def issuers_in_question(question: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """Canonical issuers named in a question, in order of appearance.

    An issuer's place is that of its first listed name that occurs.
    """
    low = F.lower(question)
    found = []
    for order, (canon, names) in enumerate(dictionary.question_issuers):
        at = F.coalesce(*[F.nullif(F.locate(name, low), F.lit(0)) for name in names])
        found.append(F.when(at.isNotNull(), F.struct(
            at.alias("at"), F.lit(order).alias("order"), F.lit(canon).alias("canon"))))
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    return F.transform(ordered, lambda s: s["canon"])


def _names_of(issuer: Column, dictionary: Dictionary, strict: bool) -> Column:
    """Words that mark a question segment as speaking of ``issuer``."""
    strict_words = dict(dictionary.strict_segment_words)
    names = {canon: [strict_words.get(canon, canon)] if strict else list(own)
             for canon, own in dictionary.question_issuers}
    return F.coalesce(T.table(names, "map<string,array<string>>")[issuer], F.array(issuer))


def _opening_pattern(prefixes) -> str:
    """Conversational openings, each optional and in order, written with or without accents."""
    accents = {"a": "áÁ", "e": "éÉ", "i": "íÍ", "o": "óÓ", "u": "úÚüÜ"}

    def letter(ch: str) -> str:
        return f"[{ch}{ch.upper()}{accents.get(ch, '')}]" if ch.isalpha() else ch

    return "(?U)^" + "".join(rf"(?:{''.join(map(letter, p))}\s*)?" for p in prefixes)


def issuer_segment(question: Column, issuer: Column, dictionary: Dictionary = DEFAULT_DICTIONARY,
                   strict: bool = False) -> Column:
    """First segment that names the issuer, else the whole question, without its opening phrase."""
    def own(names: Column) -> Column:
        return F.filter(
            T.segments(T.strip(question)), lambda s: F.exists(names, lambda n: F.contains(T.normalize(s), n)))

    found = F.get(T.let(_names_of(issuer, dictionary, strict), own), F.lit(0))
    segment = F.coalesce(found, T.strip(question))
    return F.regexp_replace(segment, _opening_pattern(dictionary.segment_prefixes), "")


def _own_name_words(issuer: Column, dictionary: Dictionary) -> Column:
    parts = {canon: sorted({w for name in names for w in name.split()})
             for canon, names in dictionary.question_issuers}
    return F.coalesce(
        T.table(parts, "map<string,array<string>>")[issuer], F.array().cast("array<string>"))


def _anchors(clause: Column, issuer: Column, dictionary: Dictionary, strict: bool) -> Column:
    names = T.proper_names(clause, issuer)
    if strict:
        return names
    return F.array_except(names, _own_name_words(issuer, dictionary))


def subqueries(questions: DataFrame, title_words: DataFrame | None = None,
               dictionary: Dictionary = DEFAULT_DICTIONARY, strict: bool = False) -> DataFrame:
    """(query_id, sid, multi, text, issuer_filter, must, boost) from (query_id, question, issuer_filter).

    One issuer gives one row per clause that asks for something, several issuers one row each, none
    (or an explicit filter) the whole question. ``title_words`` (issuer_key, token) are words of
    document names and titles, which never serve as anchors.
    """
    q = F.col("question")
    empty = F.array().cast("array<string>")

    def sub(text: Column, issuer: Column, anchors: Column) -> Column:
        return F.struct(text.alias("text"), issuer.cast("string").alias("issuer"), anchors.alias("anchors"))

    issuers = F.col("__issuers")
    only = F.get(issuers, F.lit(0))
    asked = F.filter(T.clauses(q), lambda c: ~T.is_preamble(c, only, dictionary))
    single = F.when(F.size(asked) == 0, F.array(sub(q, only, empty))).otherwise(
        F.transform(asked, lambda c: sub(c, only, _anchors(c, only, dictionary, strict))))

    def segment(issuer: Column) -> Column:
        return T.let(issuer_segment(q, issuer, dictionary, strict), lambda text: sub(
            text, issuer, _anchors(text, issuer, dictionary, strict)))

    multi = F.col("issuer_filter").isNull() & (F.size(issuers) > 0)
    plan = (
        F.when(~multi, F.array(sub(q, F.col("issuer_filter"), empty)))
        .when(F.size(issuers) == 1, single)
        .otherwise(F.transform(issuers, segment))
    )
    subs = (
        questions.withColumn("__issuers", issuers_in_question(q, dictionary))
        .select("query_id", "question", multi.alias("multi"), F.posexplode(plan).alias("sid", "s"))
        .select("query_id", "question", "sid", "multi", "s.text",
                T.issuer_key(F.col("s.issuer"), dictionary).alias("issuer_filter"), "s.anchors")
    )
    if title_words is not None:
        named = subs.select("query_id", "sid", "issuer_filter", F.posexplode("anchors").alias("at", "anchor"))
        # The strict mode compares the written name, which a canonical key hardly ever equals.
        owner = title_words["issuer"] if strict else title_words["issuer_key"]
        known = (F.col("issuer_filter") == owner) & (F.col("anchor") == title_words["token"])
        kept = named.join(title_words, known, "left_anti").groupBy("query_id", "sid").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "anchor"))), lambda s: s["anchor"])
            .alias("kept"))
        subs = subs.join(kept, ["query_id", "sid"], "left").withColumn(
            "anchors", F.coalesce("kept", empty)).drop("kept")
    whole = Window.partitionBy("query_id").orderBy("sid").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    all_anchors = F.flatten(F.collect_list("anchors").over(whole))
    one_issuer = F.size(F.array_distinct(F.collect_list("issuer_filter").over(whole))) == 1
    own = F.col("anchors")
    boost = F.when(
        F.col("multi") & one_issuer, F.filter(F.col("__all"), lambda a: ~F.array_contains(own, a))
    ).otherwise(empty)
    return (
        subs.withColumn("__all", all_anchors).withColumn("boost", boost)
        .select("query_id", "sid", "multi", "text", "issuer_filter", F.col("anchors").alias("must"), "boost")
    )


def title_words(documents: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(issuer, issuer_key, token): search words of each issuer's document names and titles."""
    both = F.concat(T.words(F.col("document"), dictionary), T.words(F.col("title"), dictionary))
    distinct = documents.select("issuer", "document", "title").distinct()
    return distinct.select(
        "issuer", T.issuer_key(F.col("issuer"), dictionary).alias("issuer_key"), F.explode(both).alias("token")
    ).distinct()


def variants(subs: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """One row per wording of a sub-query: adds (vid, variant)."""
    return subs.select(
        "query_id", "sid", "multi", "issuer_filter", "must", "boost",
        F.posexplode(expand_question(F.col("text"), dictionary)).alias("vid", "variant"))


LIST_KEYS = ["query_id", "sid", "vid"]


def search_words(wordings: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(list keys, issuer_filter, pos, token): every word occurrence of every wording."""
    return wordings.select(
        *LIST_KEYS, "issuer_filter", F.posexplode(T.words(F.col("variant"), dictionary)).alias("pos", "token"))


def weigh_rare_words(occurrences: DataFrame, vocabulary: DataFrame, by: list[str] = LIST_KEYS) -> DataFrame:
    """Add ``qtf``: 3 for the occurrences of a wording's rarest words (idf above 3), else 1.

    The three best-placed occurrences by idf decide; a word that repeats may fill several places.
    """
    needed = occurrences.select(F.col("token").alias("term")).distinct()
    idf = vocabulary.join(needed, "term", "left_semi").select(F.col("term").alias("token"), "idf")
    known = occurrences.join(idf, "token", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("idf").desc(), "pos"))
    rare = F.when((place <= RARE_WORDS) & (F.col("idf") > RARE_IDF), 1).otherwise(0)
    same_word = Window.partitionBy(*by, "token")
    return (
        known.withColumn("__rare", rare)
        .withColumn("qtf", F.when(F.max("__rare").over(same_word) == 1, float(RARE_REPEAT)).otherwise(1.0))
        .drop("__rare")
    )


def tfidf_terms(weighed: DataFrame) -> DataFrame:
    return weighed.select(*LIST_KEYS, "issuer_filter", F.col("token").alias("term"), "qtf")


def bm25_terms(weighed: DataFrame, wordings: DataFrame) -> DataFrame:
    """Analysed terms with their clause weight; anchors of sister clauses join with weight 1.5.

    A word that the analyser cuts into several terms counts each of them.
    """
    own = weighed.select(
        *LIST_KEYS, "issuer_filter", F.explode(T.analysed_terms(F.col("token"))).alias("term"), "qtf")
    sisters = wordings.select(
        *LIST_KEYS, "issuer_filter", F.explode("boost").alias("anchor")
    ).select(*LIST_KEYS, "issuer_filter", F.explode(T.analysed_terms(F.col("anchor"))).alias("term"),
             F.lit(SISTER_BOOST).alias("qtf"))
    return own.unionByName(sisters).groupBy(*LIST_KEYS, "issuer_filter", "term").agg(
        F.sum("qtf").alias("query_weight"))
