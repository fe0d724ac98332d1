import urllib.error

import pytest
from pyspark.sql import functions as F

from groundline.connectors.http import ChatClient, EmbeddingClient
from groundline.functions.prompts import model_file
from groundline.operators.number_index import number_index
from groundline.plans.answering import answer
from tests.test_grounding import CHUNK, SEGMENT

ECHO = ("\n\n🚨 [AUDITORÍA NUMÉRICA - REINTENTO 1/3]:\nTu respuesta anterior incluyó cifras NO verificadas: "
        "'usd|999000000' no existe en ningún documento.")


def scripted(*replies):
    """Model that answers by the number of corrections already in the prompt."""
    def model(system, prompt):
        return replies[min(prompt.count("REINTENTO"), len(replies) - 1)]

    return model


def ask(spark, model, context, question="¿Cuáles fueron las ventas?", **options):
    df = spark.createDataFrame([(1, question, context)], "query_id long, question string, context string")
    return answer(df, model, **options).first()


def test_valid_at_once(spark):
    r = ask(spark, scripted("<think>x</think>Las ventas fueron US$ 450 millones."), "Ventas por US$ 450 millones.")
    assert (r["is_valid"], r["attempts"], r["auto_corrected"]) == (True, 1, False)
    assert r["final_response"] == "Las ventas fueron US$ 450 millones." and r["attempt_log"] == []


def test_corrected_on_second_attempt(spark):
    r = ask(spark, scripted("Ventas de US$ 999 millones.", "Ventas de US$ 450 millones."), "Ventas por US$ 450 millones.")
    assert (r["is_valid"], r["attempts"], r["auto_corrected"]) == (True, 2, True)
    assert r["attempt_log"][0]["hallucinated_money"] == ["usd|999000000"]


def test_echo_is_no_answer(spark):
    context = "Ferreycorp reportó ventas por US$ 450 millones en 2025."
    r = ask(spark, scripted("Las ventas de Ferreycorp fueron US$ 999 millones en 2025.", ECHO), context)
    assert not r["is_valid"] and "AUDITOR" not in r["final_response"] and "999" in r["final_response"]
    assert "AUDITOR" in r["raw_response"] and "~~US$ 999 millones~~" in r["final_response"] and r["attempts"] == 2
    r = ask(spark, scripted(ECHO), context)
    assert not r["is_valid"] and r["final_response"] == ""


def test_rebound_stops(spark):
    r = ask(spark, scripted("Hubo 77 casos."), "Sin cifras.", retries=5)
    assert (r["attempts"], r["is_valid"], r["hallucinated_numbers"]) == (2, False, ["77"])
    assert "~~77~~" in r["final_response"] and r["corrections"][0]["kind"] == "NoEspecificado"


@pytest.mark.parametrize("strict_attribution", [False, True])
def test_segment_as_total(spark, strict_attribution):
    children = spark.createDataFrame([SEGMENT], CHUNK)
    r = ask(spark, scripted("Las ventas totales de Ferreycorp alcanzaron US$ 950 millones."),
            "Ferreycorp reportó ventas del segmento gran minería por US$ 950 millones en 2025.",
            children=children, strict_attribution=strict_attribution)
    assert r["is_valid"] is (not strict_attribution)
    (f,) = r["attribution"]
    assert f["segment_qualifier"] and not f["is_misattribution"]


def test_correction_from_index(spark):
    pages = spark.createDataFrame([("Z.md", 4, "Hubo S/. 405 millones de patrimonio")], "document string, page int, text string")
    r = ask(spark, scripted("Patrimonio de US$ 405 millones."), "US$ 1 millones", index=number_index(pages), retries=1)
    assert (r["corrections"][0]["kind"], r["corrections"][0]["source"]) == ("Moneda", "Z.md pág. 4")


def test_clients():
    calls = []

    def transport(url, body, timeout):
        calls.append((url, body))
        if url.endswith("/health"):
            raise urllib.error.URLError("refused")
        if "embed" in url:
            return {"data": [{"index": 0, "embedding": [0.5, 0.5, 0.5, 0.5]}]}
        return {"choices": [{"message": {"role": "assistant", "content": "hola"}}]}

    chat = ChatClient("http://host:1/", "m", transport=transport)
    assert chat.is_healthy() and chat("s", "u") == "hola"
    assert calls[-1][0] == "http://host:1/v1/chat/completions" and calls[-1][1]["stream"] is False
    assert EmbeddingClient("http://host/embed", transport=transport).embed_query("q") == [0.5] * 4
    assert calls[-1][1] == {"input": ["q"], "mode": "query"}
    with pytest.raises(ValueError):
        EmbeddingClient("http://x", transport=lambda *a: {}).embed_query("q")

    def broken(*_):
        raise urllib.error.URLError("down")

    with pytest.raises(RuntimeError):
        ChatClient("http://host", "m", transport=broken)("s", "u")
    assert not ChatClient("http://host", "m", transport=broken).is_healthy()


@pytest.mark.parametrize("name, file", [
    ("qwen2.5-3b", "qwen2.5-3b-instruct-q4_k_m.gguf"), ("qwen3.8-2b", "Qwen3.8-2B-Q4_K_M.gguf"),
    ("qwen3.8-4b", "Qwen3.8-4B-Q4_K_M.gguf"), ("other", "other")])
def test_model_file(name, file):
    assert model_file(name) == file
