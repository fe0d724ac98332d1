import pytest
from pyspark.sql import functions as F

from groundline.functions.numeric import MONEY_TYPE, PERCENT_TYPE
from groundline.operators import attribution as A
from groundline.operators import corrections as C
from groundline.operators import grounding as G

SALES = "Ferreycorp reportó ventas por 59,968 unidades en 2025."
MIXED = "El patrimonio superó S/. 405 millones y las ventas fueron US$ 2,177 millones."
CASES = [
    ("En 2025, Ferreycorp reportó 59,968 unidades vendidas con un margen de 14.8%.",
     "Ferreycorp reportó ventas por 59,968 unidades y un margen de 14.8% en 2025.", "¿Ventas en 2025?", True, set()),
    ("Ferreycorp vendió 99,999 unidades y obtuvo una ganancia de 750 millones.", SALES, "¿Ventas?", False,
     {"99999", "750"}),
    ("La tasa fue de 32.", "La tasa de pobreza fue 32.2% en 2024.", "¿Tasa?", False, {"32"}),
    ("El patrimonio superó US$ 405 millones.", MIXED, "¿Patrimonio?", False, set()),
    ("Las ventas fueron $2,177 millones.", "Ferreycorp reportó US$ 2,177 millones.", "¿Ventas?", True, set()),
    ("El patrimonio superó S/. 405,000,000.", "El patrimonio superó S/. 405 millones.", "¿Patrimonio?", True, set()),
    ("El PBI creció 2.7% en 2024.", "GDP growth is expected to be 2.7 percent in 2024.", "¿PBI?", True, set()),
    ("El ratio fue de 3.5x y las inversiones alcanzaron S/. 900 millones.",
     "El ratio deuda EBITDA fue 1.4x en 2025 frente a 1.8x en 2024. Se invirtieron S/. 450 millones en CAPEX.",
     "¿Ratio en 2025?", False, {"35", "900"}),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)],
                               "id long, response string, context string, question string")
    rows = {r["id"]: r for r in G.verify(df).collect()}
    for i, case in enumerate(CASES):
        assert rows[i]["is_valid"] is case[3], case
        assert set(rows[i]["hallucinated_numbers"]) >= case[4]
    assert [m["raw_text"] for m in rows[3]["hallucinated_money"]] == ["US$ 405 millones"]


def strike(spark, text, numbers, money=(), percent=(), strict=False):
    df = spark.createDataFrame(
        [(text, list(numbers), list(money), list(percent))],
        f"t string, n array<string>, m {MONEY_TYPE}, p {PERCENT_TYPE}")
    return df.select(G.strike_out(*map(F.col, "tnmp"), strict=strict)).first()[0]


def test_strike_out(spark):
    note = G.UNVERIFIED_NOTE
    text = "El patrimonio de US$ 32 mil millones fue reportado, 32 veces en 1932."
    money = [("usd", "32", "32000000000", "US$ 32 mil millones")]
    out = strike(spark, text, ["32"], money)
    assert out == (f"El patrimonio de ~~US$ 32 mil millones~~ {note} fue reportado, ~~32~~ {note} veces en 1932.")
    assert f"19~~32~~" in strike(spark, text, ["32"], money, strict=True)
    assert strike(spark, "Hubo 99,999 casos", ["99999"]) == f"Hubo ~~99,999~~ {note} casos"
    assert strike(spark, "Hubo 99,999 casos", ["99999"], strict=True) == "Hubo 99,999 casos"
    assert strike(spark, "Nada", []) == "Nada"
    assert strike(spark, "un 5.5% y 55", ["55"], percent=[("%|55", "55", "5.5%")]) == (
        f"un ~~5.5%~~ {note} y ~~55~~ {note}")


CHUNK = "child_id string, issuer string, indicator string, content string"
TOTAL = ("c1", "Ferreycorp", "ventas", "Las ventas totales de Ferreycorp fueron US$ 2,177 millones en 2025.")
SEGMENT = ("c2", "Ferreycorp", "ventas", "Las ventas del segmento gran minería alcanzaron US$ 950 millones.")


def attribute(spark, response, *chunks):
    children = spark.createDataFrame(list(chunks), CHUNK)
    answers = spark.createDataFrame([(1, response)], "query_id long, response string")
    return A.findings(A.claims(answers, ["query_id"]), A.pair_amounts(children), ["query_id"]).collect()


def test_attribution(spark):
    claim = "Las ventas totales de Ferreycorp fueron US$ 950 millones."
    (f,) = attribute(spark, claim, TOTAL)
    assert (f["issuer"], f["indicator"], f["claimed_currency"], f["claimed_value"]) == (
        "Ferreycorp", "ventas", "usd", "950000000")
    assert f["is_misattribution"] and not f["segment_qualifier"] and f["correct_value"] == "usd|2177000000"
    (f,) = attribute(spark, claim, TOTAL, SEGMENT)
    assert f["segment_qualifier"] and not f["is_misattribution"] and f["correct_value"] is None
    assert attribute(spark, "Las ventas de Ferreycorp alcanzaron US$ 2,177 millones.", TOTAL) == []


def correct(spark, numbers=(), money=(), percent=(), index=None, context=""):
    df = spark.createDataFrame(
        [(1, context, list(numbers), list(money), list(percent))],
        f"query_id long, context string, hallucinated_numbers array<string>, hallucinated_money {MONEY_TYPE}, "
        f"hallucinated_percent {PERCENT_TYPE}")
    if index is not None:
        index = spark.createDataFrame(index, "number string, document string, page int, snippet string")
    return C.find_corrections(df, ["query_id"], index).orderBy("ord").collect()


def test_corrections(spark):
    index = [("405", "Memoria-Financiera.md", 3, "patrimonio que superó los S/. 405 millones de soles"),
             ("405", "Z.md", 9, "S/. 405 millones"), ("77", "Z.md", 4, "fueron 77 casos")]
    usd = ("usd", "405", "405000000", "US$ 405 millones")
    (c,) = correct(spark, money=[usd], index=index)
    assert (c["kind"], c["suggested_value"]) == ("Moneda", "pen|405000000")
    assert c["source"] == "Memoria-Financiera.md pág. 3"
    (c,) = correct(spark, money=[("usd", "405", "405", "US$ 405")], index=index)
    assert c["kind"] == "Representacion" and c["suggested_value"] == index[0][3]
    (c,) = correct(spark, money=[("usd", "32", "32000000000", "US$ 32 mil millones")])
    assert c["kind"] == "NoEspecificado"
    rows = correct(spark, numbers=["77", "88", "99"], percent=[("%|5", "5", "5%")], index=index,
                   context="el 88 existe")
    assert [(r["hallucinated"], r["kind"], r["source"]) for r in rows] == [
        ("77", "EnCorpus", "Z.md pág. 4"), ("88", "EnCorpus", None), ("99", "NoEspecificado", None),
        ("%|5", "NoEspecificado", None)]


def test_correction_prompt(spark):
    schema = ("array<struct<kind:string,hallucinated:string,suggested_value:string,source:string,snippet:string>>")
    rows = [("NoEspecificado", "a", None, None, None), ("Moneda", "b", "pen|1", "D pág. 1", None),
            ("Representacion", "c", None, "D pág. 2", None), ("EnCorpus", "d", None, None, None)]
    df = spark.createDataFrame([(rows + rows,)], f"c {schema}")
    lines = df.select(G.correction_prompt(F.col("c"), 1, 3)).first()[0].split("\n")
    assert "REINTENTO 1/3" in lines[2] and len([l for l in lines if l.startswith("  - ")]) == 5
    assert "'pen|1' [D pág. 1]" in lines[5] and "[el contexto recuperado]" in lines[7]


def test_texts_may_hold_the_characters_of_marks(spark):
    from pyspark.sql import functions as F

    from groundline.functions import numeric as N
    from groundline.operators.grounding import UNVERIFIED_NOTE, strike_out

    odd = "".join(chr(c) for c in (0xE000, 0xE010, 0xE002, 0xE003, 0xE003, 0xE010, 0xE001, 0xE100))
    amounts = [f"US$ {n} millones" for n in range(101, 121)]
    text = odd + " " + ", ".join(amounts) + " " + odd
    df = spark.createDataFrame([(text,)], "t string")
    none = F.array().cast("array<string>")
    money = N.money_phrases(F.col("t"))
    empty = F.filter(N.percent_phrases(F.col("t")), lambda p: F.lit(False))
    got = df.select(strike_out(F.col("t"), none, money, empty)).first()[0]
    assert got == odd + " " + ", ".join(f"~~{a}~~ {UNVERIFIED_NOTE}" for a in amounts) + " " + odd


def test_ids_above_31_bits(spark, tmp_path):
    from groundline.plans import queries as Q

    big = 2**33 + 7
    spark.createDataFrame([(big, "In 2024 sales were 1,250 units.", "en", "src1", 30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    assert {r["page"] for r in Q.number_locations(spark, str(tmp_path)).collect()} == {big}
    assert [r["p_idx"] for r in Q.parents(spark, str(tmp_path)).collect()] == [big]


def test_equal_amounts_are_looked_up_once(spark):
    index = spark.createDataFrame([("405", "M", n, "S/. 405 millones") for n in range(3)], "number string, document string, page int, snippet string")
    usd = ("usd", "405000000", "405")
    money = spark.createDataFrame([((c, b, v, "x"),) for c, v, b in [usd] * 50 + [("usd", None, "405"), ("usd", "9", "9")]],
                                  "m struct<currency:string,base_digits:string,value:string,raw_text:string>")
    rows = C.look_up_amounts(money, index, C.first_locations(index)).collect()
    assert sorted((r["value"] or "", r["alt"] and r["alt"]["alt_page"], r["loc"]["page"]) for r in rows) == [("", None, 0), ("405000000", 0, 0)]


def test_figures_are_numbered_by_answer(spark):
    one = ([("usd", "405", "405000000", "US$ 405 millones"), ("usd", "9", "9", "$9")], ["77", "12"], [("%|5", "5", "5%")])
    schema = (f"query_id long, context string, hallucinated_money {MONEY_TYPE}, hallucinated_numbers array<string>, "
              f"hallucinated_percent {PERCENT_TYPE}")
    index = spark.createDataFrame([("405", "M", 1, "S/. 405 millones"), ("9", "M", 2, "son 9")], "number string, document string, page int, snippet string")

    def run(*ids):
        df = spark.createDataFrame([(i, "", *one) for i in ids], schema)
        return [(r["query_id"], r["ord"], r["hallucinated"], r["kind"]) for r in C.find_corrections(df, ["query_id"], index).collect()]

    kinds = [("usd|405000000", "Moneda"), ("usd|9", "Representacion"), ("12", "NoEspecificado"), ("77", "NoEspecificado"), ("%|5", "NoEspecificado")]
    assert sorted(run(1, 2), key=str) == sorted(((i, n, *k) for i in (1, 2) for n, k in enumerate(kinds)), key=str)
    # a key without a value is a key
    assert sorted(run(None)) == [(None, n, *k) for n, k in enumerate(kinds)]
    # answers that share a key are numbered through
    twice = sorted(run(1, 1))
    assert [r[1] for r in twice] == list(range(10)) and [r[2:] for r in twice] == [k for k in kinds for _ in range(2)]
