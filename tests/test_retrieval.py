import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.operators import decomposition as D
from groundline.operators import ranking as R
from groundline.operators.index import TextIndex, build_text_index
from groundline.plans.ingest import corpus_from_pages
from groundline.plans.retrieval import one_question, retrieve
from groundline.session import cut_lineage
from tests.test_chunking import PAGE

META = {
    "F": ("Ferreycorp", "memoria", "2025", "Memoria Ferreycorp 2025"),
    "E": ("Financiera Efectiva", "memoria", "2025", "Memoria Efectiva 2025"),
    "W": ("Banco Mundial", "reporte_macro", "2024", "Macro Poverty Outlook"),
}
COMPOSITE = ("Comparando los reportes: que PBI proyecto el Banco Mundial para 2024, que ventas en dolares reporto "
             "Ferreycorp en 2025 y que patrimonio supero Financiera Efectiva?")
PAGES = [
    ("WorldBank_2024.md", 1, "El Banco Mundial proyecta un crecimiento del PBI de 2.7% para Perú en 2024.", "W"),
    ("Efectiva_2025.md", 3, "Financiera Efectiva superó un patrimonio de S/ 405 millones en 2025.", "E"),
    ("Ferreycorp_2025.md", 38, "La corporación alcanzó ventas en dólares de US$ 2,177 millones en 2025.", "F"),
    ("Ferreycorp_2025.md", 100, "Las ventas netas ascendieron a S/. 7,798.3 millones en soles en 2025.", "F"),
]


def corpus_of(spark, rows):
    pages = spark.createDataFrame([(d, p, t, *META[m]) for d, p, t, m in rows], PAGE)
    corpus = corpus_from_pages(pages)
    corpus.parents, corpus.children = cut_lineage(corpus.parents), cut_lineage(corpus.children)
    return corpus


def ask(spark, rows, question, issuer=None, k=8, vector=None, vectors=None, **options):
    corpus = corpus_of(spark, rows)
    index = TextIndex(*[cut_lineage(getattr(build_text_index(corpus.children), t)) for t in TextIndex.TABLES])
    asked = one_question(spark, question, issuer, vector)
    return retrieve(asked, corpus.parents, corpus.children, index, k, vectors, **options).orderBy("rank").collect()


@pytest.mark.parametrize("strict", [False, True])
def test_three_issuers(spark, strict):
    found = ask(spark, PAGES, COMPOSITE, k=3, strict=strict)
    texts = [r["content"] for r in found]
    assert len(found) == 3
    place = {key: next((i for i, t in enumerate(texts) if key in t), None) for key in ("2,177", "7,798", "405")}
    assert place["2,177"] is not None and place["405"] is not None
    assert place["7,798"] is None or place["2,177"] < place["7,798"]


def test_issuer_filter_and_citation(spark):
    rows = [("Financiera_Efectiva_2025.md", 14, "Financiera Efectiva reportó una utilidad neta de S/. 152 millones y "
             "provisiones de S/. 45 millones.", "E")] + [p for p in PAGES if p[3] != "E"]
    found = ask(spark, rows, "¿Cuál fue la utilidad neta de Financiera Efectiva?", "Financiera", 3)
    assert "152 millones" in found[0]["content"]
    assert found[0]["citations"] == ["Financiera Efectiva_memoria_2025 (pág. 14)"]
    assert {r["issuer"] for r in found} == {"Financiera Efectiva"}


def test_sibling_of_a_split_page(spark):
    text = ("La carta del presidente y el contexto macroeconómico del Perú en 2025: crecimiento de 3.3%, inversión "
            "de 1.5% del PBI, BCR en 4.25%. ") * 40 + "US$ 2,177 millones en 2025."
    found = ask(spark, [("Ferreycorp_2025.md", 5, text, "F")],
                "ventas en dolares de la carta del presidente 2025", k=4)
    assert any("2,177" in r["content"] for r in found)


def test_neighbours_fill_up(spark):
    rows = [("Ferreycorp_2025.md", p, f"relleno numero {p} palabra{p}", "F") for p in range(1, 9)]
    rows.append(("Ferreycorp_2025.md", 10, "camiones de mineria 32", "F"))
    found = ask(spark, rows, "camiones de mineria", k=8)
    assert [(r["page"], round(r["score"], 6)) for r in found][0][0] == 10
    near = {r["page"] for r in found[1:]}
    assert near == {7, 8}


def test_vector_ranker(spark):
    rows = [
        ("Ferreycorp_2025.md", 1, "las ventas en dólares de la corporación fueron US$ 2,177 millones en 2025", "F"),
        ("Ferreycorp_2025.md", 2, "las ventas netas ascendieron a S/. 7,798.3 millones en soles en 2025", "F"),
        ("Efectiva_2025.md", 3, "el patrimonio superó S/ 405 millones en 2025", "E"),
    ]
    corpus = corpus_of(spark, rows)
    near = F.when(F.col("content").contains("dólares"), F.array(F.lit(0.95), F.lit(0.05))).when(
        F.col("content").contains("netas"), F.array(F.lit(0.05), F.lit(0.95))).otherwise(
        F.array(F.lit(0.5), F.lit(0.5)))
    from groundline.functions.text import issuer_key
    vectors = corpus.children.select("child_id", issuer_key(F.col("issuer")).alias("issuer_key"), near.alias("vec"))
    question = ("que ventas reporto Ferreycorp en dolares 2025 y que patrimonio supero Financiera Efectiva")
    found = ask(spark, rows, question, k=3, vector=[0.9, 0.1], vectors=vectors)
    texts = [r["content"] for r in found]
    assert "2,177" in texts[0] or texts.index(next(t for t in texts if "2,177" in t)) < texts.index(
        next(t for t in texts if "7,798" in t))


def issuers(value, text):
    return value(D.issuers_in_question, text)


def test_issuers_in_question(value):
    assert issuers(value, "PBI del Banco Mundial, ventas de Ferreycorp y patrimonio de Financiera Efectiva") == [
        "worldbank", "ferreycorp", "financieraefectiva"]
    assert issuers(value, "¿cuál fue el crecimiento del PBI en 2024?") == []
    assert len(issuers(value, "Ferreycorp y Ferreyros y la financiera efectiva")) == 2
    assert issuers(value, "Banco Mundial (WorldBank)") == ["worldbank"]


def test_subqueries(spark):
    asked = spark.createDataFrame([
        (1, COMPOSITE, None), (2, "ventas totales", None), (3, "ventas de Ferreycorp", "Ferreycorp"),
        (4, "En el Annual Report 2025 de Microsoft, ¿qué ingresos anuales tuvo Azure y cuántos modelos hay en Foundry?",
         None)], "query_id long, question string, issuer_filter string")
    rows = D.subqueries(asked).orderBy("query_id", "sid").collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert [r["issuer_filter"] for r in by[1]] == ["worldbank", "ferreycorp", "financieraefectiva"]
    assert by[1][0]["text"] == "que PBI proyecto el Banco Mundial para 2024"
    assert "Ferreycorp" in by[1][1]["text"] and "patrimonio" in by[1][2]["text"]
    assert by[1][0]["must"] == ["pbi"] and not by[1][0]["boost"]
    assert (by[2][0]["multi"], by[2][0]["issuer_filter"]) == (False, None)
    assert (by[3][0]["multi"], by[3][0]["issuer_filter"]) == (False, "ferreycorp")
    assert [(r["must"], r["boost"]) for r in by[4]] == [(["azure"], ["foundry"]), (["foundry"], ["azure"])]


def test_fusion_and_cosine(spark):
    ranked = spark.createDataFrame(
        [(1, c, r) for lst in (["A", "B", "C"], ["B", "A", "D"]) for r, c in enumerate(lst, 1)],
        "query_id long, child_id string, rank int")
    fused = R.reciprocal_rank_fusion(ranked, ["query_id"], top_n=3).orderBy("rank").collect()
    assert [r["child_id"] for r in fused] == ["A", "B", "C"]
    pair = spark.createDataFrame([([1.0, 0.0, 1.0], [1.0, 0.0, 1.0]), ([1.0, 0.0, 1.0], [0.0, 1.0, 0.0]),
                                  ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in pair.select(R.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.0])


def test_text_rankers_against_brute_force(spark):
    texts = ["ocho dos dos tres", "dos cuatro", "tres tres cinco ocho", "seis", "dos seis siete"]
    rows = [(f"d{i}", f"X{i % 2}", t, "d", "t") for i, t in enumerate(texts)]
    children = spark.createDataFrame(
        rows, "child_id string, issuer string, content string, document string, title string")
    index = build_text_index(children)
    n, docs = len(texts), [t.split() for t in texts]
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    avgdl = sum(map(len, docs)) / n
    for r in index.bm25.collect():
        d = docs[int(r["child_id"][1:])]
        tf = d.count(r["term"])
        idf = math.log(1 + (n - df[r["term"]] + 0.5) / (df[r["term"]] + 0.5))
        expected = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avgdl))
        assert r["weight"] == pytest.approx(expected)
    for r in index.tfidf.collect():
        d = docs[int(r["child_id"][1:])]
        vec = {w: d.count(w) * (math.log((n + 1) / (df[w] + 1)) + 1) for w in d}
        assert r["weight"] == pytest.approx(vec[r["term"]] / math.sqrt(sum(v * v for v in vec.values())))


def test_vector_paths_agree(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(300, 8))
    vectors = spark.createDataFrame(
        [(f"v{i:03d}", f"issuer{i % 3}", [float(x) for x in v]) for i, v in enumerate(data)],
        "child_id string, issuer_key string, vec array<float>")
    asked = [(j, "issuer1" if j % 2 else None, [float(x) for x in rng.normal(size=8)]) for j in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, issuer_filter string, vec array<float>")
    collect = lambda df: sorted((r["query_id"], r["rank"], r["child_id"]) for r in df.collect())
    small = collect(R.vector_rank(queries, vectors, 5))
    assert small == collect(R.vector_rank(queries, vectors, 5, max_query_bytes=0))
    f32 = data.astype("float32").astype("float64")
    for j, wanted, v in asked:
        q = np.asarray(v, dtype="float32").astype("float64")
        sims = f32 @ q / np.linalg.norm(f32, axis=1) / np.linalg.norm(q)
        allowed = [i for i in range(300) if (wanted is None or f"issuer{i % 3}" == wanted) and sims[i] > 0]
        best = sorted(allowed, key=lambda i: -sims[i])[:5]
        assert [c for qid, _, c in small if qid == j] == [f"v{i:03d}" for i in best]


def test_vector_file(spark, tmp_path):
    from groundline.sources.vectors import align_by_position, compute_vectors, read_vector_file

    corpus = corpus_of(spark, PAGES)
    path = tmp_path / "embeddings.bin"
    with open(path, "wb") as out:
        out.write(struct.pack("<Q", 4))
        for i in range(4):
            out.write(struct.pack("<Q3f", 3, i, i, 1.0))
    rows = align_by_position(corpus.children, read_vector_file(spark, str(path)))
    got = {r["child_id"].split("_p")[0]: list(r["vec"]) for r in rows.collect()}
    assert got["Efectiva_2025.md"] == [0.0, 0.0, 1.0] and got["WorldBank_2024.md"] == [3.0, 3.0, 1.0]
    R.check_vectors(corpus.children, rows)
    with pytest.raises(ValueError):
        R.check_vectors(corpus.children, rows.limit(2))
    with pytest.raises(ValueError):
        R.check_vectors(corpus.children, rows.withColumn(
            "vec", F.when(F.col("issuer_key") == "worldbank", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vec"))))
    unit = compute_vectors(corpus.children, lambda texts: [[len(t), 1.0] for t in texts]).first()["vec"]
    assert sum(v * v for v in unit) == pytest.approx(1.0)
