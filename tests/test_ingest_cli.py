import hashlib
import json

import pytest
from pyspark.sql import functions as F

from groundline import cli
from groundline.plans.ingest import build_corpus, load_or_build
from groundline.sources import files as S
from groundline.sources.corpus import Corpus

FERREY = ("<!-- rag:source F.pdf -->\n<!-- rag:page 38 -->\nLa corporación alcanzó ventas en dólares de US$ 2,177 millones "
          "en 2025.\n<!-- page 39 -->\n| Indicador | 2024 | 2025 |\n|---|---|---|\n| ROE | 14.2% | 16.5% |\n<!-- rag:page 40 -->\n  \n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "markdown").mkdir()
    (root / "markdown" / "Ferreycorp_Memoria_2025.md").write_text(FERREY, encoding="utf-8")
    (root / "markdown" / "Efectiva_memoria_anual_2024.md").write_text(
        "El patrimonio superó S/ 405 millones.", encoding="utf-8")
    (root / "markdown" / "roto.md").write_bytes(b"\xff\xfe\xff malo")
    (root / "document_metadata.json").write_text(json.dumps({
        "Ferreycorp_Memoria_2025.pdf": {"issuer": "Ferreycorp", "doc_type": "memoria", "year": 2025, "title": "Memoria"}}))
    return root


def test_build_and_round_trips(spark, folder, tmp_path):
    corpus = build_corpus(spark, str(folder), str(folder / "document_metadata.json"))
    parents = {(r["document"], r["page"]): r for r in corpus.parents.collect()}
    assert set(parents) == {("Ferreycorp_Memoria_2025.md", 38), ("Ferreycorp_Memoria_2025.md", 39),
                            ("Efectiva_memoria_anual_2024.md", 1)}
    assert parents[("Ferreycorp_Memoria_2025.md", 38)]["title"] == "Memoria"
    other = parents[("Efectiva_memoria_anual_2024.md", 1)]
    assert (other["issuer"], other["doc_type"], other["year"]) == ("Efectiva", "memoria anual", "2024")
    hashes = {r["file"]: r["sha256"] for r in corpus.files.collect()}
    assert hashes["Ferreycorp_Memoria_2025.md"] == hashlib.sha256(FERREY.encode()).hexdigest()
    corpus.save(str(tmp_path / "c"))
    corpus.save_json(str(tmp_path / "j"))
    stored, as_json = Corpus.load(spark, str(tmp_path / "c")), Corpus.load_json(spark, str(tmp_path / "j"))
    for name in ("parents", "children", "number_index", "files"):
        rows = sorted(map(str, getattr(corpus, name).collect()))
        for copy in (stored, as_json):
            table = getattr(copy, name).select(*getattr(corpus, name).columns)
            assert sorted(map(str, table.collect())) == rows, name


def test_pdf_fallback(spark, tmp_path):
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "A-2023.pdf").write_bytes(b"uno|  |tres 7")
    (tmp_path / "pdfs" / "B.pdf").write_bytes(b"boom")

    def extract(data):
        if data == b"boom":
            raise ValueError("broken")
        return data.decode().split("|")

    corpus = build_corpus(spark, str(tmp_path), None, extract_pdf=extract)
    rows = corpus.parents.orderBy("page").collect()
    assert [(r["document"], r["page"], r["content"], r["year"]) for r in rows] == [
        ("A-2023.pdf", 1, "uno", "2023"), ("A-2023.pdf", 3, "tres 7", "2023")]
    with pytest.raises(ValueError):
        build_corpus(spark, str(tmp_path / "nothing"))


def test_markdown_preferred_over_pdf(spark):
    pdfs = spark.createDataFrame([("X.pdf", bytearray(b"pdf")), ("Y.pdf", bytearray(b"y"))], "file string, content binary")
    markdown = spark.createDataFrame([("X.md", bytearray(b"texto"))], "file string, content binary")
    rows = S.prefer_markdown(pdfs, markdown, lambda data: [data.decode()]).orderBy("file").collect()
    assert [(r["file"], r["text"]) for r in rows] == [("X.pdf", "texto"), ("Y.pdf", "y")]


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    store = ["--data-dir", str(folder), "--store", str(tmp_path / "store")]
    cli.main([*store, "ingest", "--data-dir", str(folder)], spark)
    load_or_build(spark, "/nowhere", str(tmp_path / "store"))
    monkeypatch.setattr("groundline.connectors.http.ChatClient.is_healthy", lambda self: False)
    capsys.readouterr()
    cli.main([*store, "--json", "query", "¿ventas en dólares de Ferreycorp?"], spark)
    report = json.loads(capsys.readouterr().out)
    assert not report["ok"] and report["sources"][0] == "Ferreycorp_memoria_2025 (pág. 38)"
    monkeypatch.setattr("groundline.connectors.http.ChatClient.is_healthy", lambda self: True)
    monkeypatch.setattr("groundline.connectors.http.ChatClient.__call__",
                        lambda self, system, user: "Las ventas fueron US$ 2,177 millones.")
    engine = cli.open_engine(spark, cli.parser().parse_args(store))
    lines = iter([":filter Ferreycorp", "ventas en dólares", ":clear", ":exit"])
    cli.interactive(engine, None, lambda prompt: next(lines))
    shown = capsys.readouterr().out
    assert "VALIDADO" in shown and "FILTRO EMISOR: Ferreycorp" in shown
    assert "Tiempo LLM Total: " in shown and "Latencia Validación Numérica: " in shown
    checked = engine.report("ventas en dólares", "Ferreycorp")["guardrail"]
    assert 0 < checked["guardrail_latency_micros"] <= checked["latency_ms"] * 1000 and checked["model_ms"] > 0
    assert checked["rounds"] == [{"answers": 1, "valid": 1, "open": 0, "figures": 0, "corrections": 0}]


def test_benchmark_report(spark, monkeypatch):
    monkeypatch.setattr(cli, "BENCHMARK", (("uno", None), ("dos", "X")))

    class Pages:
        retrieve = staticmethod(lambda question, issuer: spark.createDataFrame([(["p"], 1.0)], "citations array<string>, score double"))

    engine = Pages()
    engine.spark = spark
    report = cli.benchmark(engine)
    assert len(report["retrieval_ms"]) == 2 and report["mean_retrieval_ms"] == pytest.approx(sum(report["retrieval_ms"]) / 2)
    assert report["grounded_valid"] and report["ungrounded_numbers"] == ["99999"]


def test_catalog_fields_of_other_types_are_empty(spark, tmp_path):
    import json

    from groundline.sources.files import read_catalog

    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"a.pdf": {"issuer": "X", "doc_type": 5, "year": 2024, "title": ["t"]}, "b.md": {"issuer": None, "year": "2023"}}))
    assert sorted(map(tuple, read_catalog(spark, str(path)).collect())) == [("a.pdf", "X", "", "2024", ""), ("b.md", "", "", "2023", "")]
