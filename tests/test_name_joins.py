import random

import pytest
from pyspark.sql import functions as F

from groundline.functions.indicators import contains_alias
from groundline.operators.name_joins import alias_matches, contained_names, first_canon

ALIASES = ["margen bruto", "Margen", "ROE", "r.o.e", "x&co", "&co", "deuda  neta", "--", "ñandú", "İzmir", "straße", "a", "b_c", "50%"]
TEXTS = ["El MARGEN BRUTO sube", "margen, bruto", "roe y R.O.E.", "x&co gana", "hay x&co y y&co", "deuda neta", "deuda  NETA cae", "a--b", "ÑANDÚ", "izmir",
         "STRASSE", "straße", "ab_c b_c", "", None, "margenbruto", "a" * 50_000 + " roe", "crece 50%x", "crece 50% x"]


def test_same_hits_as_one_pattern_for_each_alias(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    aliases = spark.createDataFrame([(f"C{i}", a, i) for i, a in enumerate(ALIASES)] + [("N", None, 99), ("D", "roe", 50)], "canon string, alias string, ord int")
    got = {(r["id"], r["alias"], r["canon"]) for r in alias_matches(texts, aliases, "id").collect()}
    expected = set()
    for i, alias in enumerate(ALIASES):
        if any(c.isalnum() for c in alias):
            expected |= {(r["id"], alias, f"C{i}") for r in texts.where(contains_alias(F.col("text"), alias)).collect()}
    expected |= {(i, "roe", "D") for i, a, c in expected if a == "ROE"}
    assert got == expected and len(got) > 10


def test_first_canon_follows_the_dictionary(spark):
    texts = spark.createDataFrame([(1, "deuda y margen"), (2, "nada")], "id long, text string")
    aliases = spark.createDataFrame([("M", "margen", 2), ("D", "deuda", 1)], "canon string, alias string, ord int")
    assert [tuple(r) for r in first_canon(alias_matches(texts, aliases, "id"), "id").collect()] == [(1, "D", "deuda")]


def test_hundred_thousand_aliases(spark):
    aliases = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("canon"), F.concat(F.lit("emisor "), "id").alias("alias"), F.col("id").cast("int").alias("ord"))
    texts = spark.range(500).select("id", F.concat(F.lit("la nota de Emisor "), F.col("id") * 150, F.lit(" y de emisor 7")).alias("text"))
    got = alias_matches(texts, aliases, "id").groupBy("canon").count()
    assert got.count() == 501 and got.where("canon = 'c7'").first()["count"] == 500


def test_empty_dictionary_and_texts(spark):
    texts = spark.createDataFrame([(1, "x")], "id long, text string")
    none = spark.createDataFrame([], "canon string, alias string, ord int")
    assert alias_matches(texts, none, "id").columns == ["id", "canon", "alias", "ord"] and alias_matches(texts, none, "id").isEmpty()
    assert alias_matches(texts.limit(0), spark.createDataFrame([("A", "x", 1)], none.schema), "id").isEmpty()


@pytest.mark.parametrize("q", [1, 2, 3])
def test_containment_against_all_pairs(spark, q):
    rng = random.Random(q)
    name = lambda: "".join(rng.choice("abñ ") for _ in range(rng.randint(0, 7)))
    left, right = [name() for _ in range(150)] + ["", None, "abab"], [name() for _ in range(150)] + ["", None, "abab"]
    frame = lambda names: spark.createDataFrame([(n, 1) for n in names], "name string, hay int")
    got = sorted(tuple(r) for r in contained_names(frame(left), frame(right), q).collect())
    expected = []
    for a in {n for n in left if n}:
        for b in {n for n in right if n}:
            if a == b:
                expected.append((a, b, "equal"))
            elif a in b:
                expected.append((a, b, "in"))
            elif b in a:
                expected.append((a, b, "holds"))
    assert got == sorted(expected) and {d for _, _, d in got} == {"in", "holds", "equal"}


def test_containment_of_nothing(spark):
    none = spark.createDataFrame([], "name string")
    assert contained_names(none, none).isEmpty()


def test_plain_aliases_are_found_without_a_pattern(spark):
    """Gaps count as they are written; letters match without case, also the four that fold to ASCII."""
    import re

    from groundline.operators import name_joins as J

    texts = [(1, "The  cat, the cat."), (2, "THE CAT"), (2, "the\ncat"), (3, "othe cat the cats"), (4, "the_cat"), (5, "ſet K ıs"),
             (6, None), (None, "the cat"), (7, "the cat́"), (8, "a-b c"), (9, ""), (10, "straße strasse")]
    names = ["the cat", "the\ncat", "the  cat", "set k", "is", "a-b", "b", "The Cat", "strasse", "the_cat"]
    aliases = spark.createDataFrame([("x", a, i) for i, a in enumerate(names)], "canon string, alias string, ord int")
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    wanted = rows.where("doc_id IS NOT NULL").crossJoin(aliases).where(F.rlike(
        "text", F.concat(F.lit(r"(?Ui)\b"), F.regexp_replace("alias", r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b"))))
    pairs = sorted((r.doc_id, r.alias) for r in wanted.collect())
    hits = J.alias_matches(rows, aliases, "doc_id")
    assert sorted((r.doc_id, r.alias) for r in hits.collect()) == pairs and (2, "the cat") in pairs
    assert not re.search("RLIKE", hits._jdf.queryExecution().optimizedPlan().toString(), re.I)
