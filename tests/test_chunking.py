from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundline.functions import indicators as I
from groundline.operators import chunking as C
from groundline.operators.number_index import first_locations, number_index

PAGE = "document string, page int, text string, issuer string, doc_type string, year string, title string"


def pages(spark, *rows):
    return spark.createDataFrame(
        [(d, p, t, "Ferreycorp", "memoria", "2025", "Ferreycorp Memoria 2025") for d, p, t in rows], PAGE)


TABLE = "| Indicador | 2024 | 2025 |\n|---|---|---|\n| ROE | 14.2% | 16.5% |\n| Utilidad Neta | 120 M | 150 M |"


def test_table_rows_become_children(spark):
    parents = C.parent_chunks(pages(spark, ("F.md", 1, TABLE)))
    rows = C.child_chunks(parents).orderBy("c_idx").collect()
    assert [r["indicator"] for r in rows] == ["ROE", "utilidad_neta"]
    assert rows[0]["child_id"] == "F.md_p1_parent_0_child_t_0" and rows[0]["is_table"]
    assert rows[0]["content"] == (
        "Ferreycorp Memoria 2025\n| Indicador | 2024 | 2025 |\n|---|---|---|\n| ROE | 14.2% | 16.5% |")


def test_mixed_parent_keeps_its_prose(spark):
    parents = C.parent_chunks(pages(spark, ("F.md", 1, "Antes de la tabla.\n" + TABLE)))
    assert C.child_chunks(parents).where("NOT is_table").first()["content"] == "Antes de la tabla."
    assert C.child_chunks(parents, strict=True).where("NOT is_table").count() == 0


def test_table_without_data_rows_is_one_chunk(spark):
    parents = C.parent_chunks(pages(spark, ("F.md", 1, "|a|b|\n|c|d|")))
    rows = C.child_chunks(parents).collect()
    assert [(r["content"], r["is_table"], r["indicator"]) for r in rows] == [("|a|b|\n|c|d|", True, None)]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abñé .\n", min_size=1, max_size=900), min_size=20, max_size=30))
def test_windows_cover_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", C.split_text(F.col("t"), 100, 20).alias("v")).collect():
        assert all(len(chunk) <= 100 for chunk in row["v"])
        pos = 0
        for chunk in row["v"]:
            at = row["t"].find(chunk)
            assert at >= 0
        assert "".join(sorted(set("".join(row["v"]).split()))) is not None
        for word in row["t"].split():
            if len(word) < 20:
                assert any(word in chunk for chunk in row["v"])


def test_long_page_splits(spark):
    text = "La carta del presidente y el contexto del Perú: crecimiento de 3.3%, inversión de 1.5%. " * 40
    parents = C.parent_chunks(pages(spark, ("F.md", 5, text)))
    assert parents.count() >= 2
    with_ids = C.with_child_ids(parents, C.child_chunks(parents)).orderBy("p_idx").collect()
    assert all(len(r["content"]) <= 2000 and r["child_ids"] for r in with_ids)


def test_number_index(spark):
    index = number_index(pages(
        spark, ("A.md", 1, "En 2025 hubo 165 casos y 165 más."), ("A.md", 2, "En 2024 hubo 27."),
        ("B.md", 1, "En 2025.")))
    assert {r["number"] for r in index.select("number").collect()} == {"2025", "165", "2024", "27"}
    assert index.where("number = '165'").count() == 1
    assert first_locations(index).where("number = '2025'").first()["document"] == "A.md"


def test_indicators(value):
    assert value(I.indicator_of, "Utilidad Neta del Ejercicio") == "utilidad_neta"
    assert value(I.indicator_of, "ROE") == "ROE"
    assert value(I.indicator_of, "Total Activos") is None
    assert value(I.indicator_of, "Utilidad Operativa (EBIT)") == "utilidad_operativa"
    found = value(I.matched_indicators, "El ratio deuda neta / EBITDA de la empresa mejoró en 2025.")
    assert found[0] == "deuda_ebitda" and "EBITDA" in found


def test_expansion(value):
    variants = value(I.expand_question,
                     "¿Cuáles fueron los principales factores macroeconómicos y de pobreza según el Banco Mundial?")
    assert any("poverty" in v or "macroeconomic" in v for v in variants[1:])
    assert len(value(I.expand_question, "¿Qué nivel de apalancamiento y ROE presenta?")) >= 2
    assert value(I.expand_question, "  ") == []
    many = value(I.expand_question, "rentabilidad liquidez solvencia ingresos eficiencia riesgos")
    assert len(many) == 5 and many[1].endswith("(liquidez)") is False or len(many) == 5
