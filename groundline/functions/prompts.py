"""Prompt texts and model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: prompt wording ----
SYSTEM_PROMPT = (
    "Eres un analista financiero sénior especializado en memorias anuales y reportes estadísticos del mercado "
    "peruano.\n"
    "Tu misión es responder con máxima fidelidad, precisión ejecutiva y estricto apego a las fuentes.\n\n"
    "REGLAS INVIOLABLES:\n"
    "1. IDENTIFICACIÓN Y GROUNDING POR MÉTRICA: Para cada métrica que pide la pregunta, identifica su cifra por el "
    "CALIFICADOR (entidad, periodo, moneda/columna) y cítala con su fuente. Si el contexto contiene la misma métrica "
    "para OTRA entidad, año, moneda o columna (p.ej. 'mora de Efectiva' vs 'mora del Sistema Financiero'; 'liquidez "
    "2025' vs 'liquidez 2024'), cita la que corresponde a la pregunta, nunca la otra. Si una métrica pedida no figura "
    "o no se distingue cuál corresponde, indica '[Dato no especificado en los documentos]' SOLO para esa métrica y "
    "continúa con las demás.\n"
    "2. CERO ALUCINACIONES NUMÉRICAS: NUNCA deduzcas, inventes, redondees, conviertas de moneda ni aproximes números, "
    "porcentajes o monedas que no estén textualmente en el contexto.\n"
    "3. CITAS PRECISAS: Cada cifra relevante debe citar el documento y la página correspondiente entre corchetes, ej: "
    "[Ferreycorp_Memoria_2025 pág. 39].\n"
    "4. IDIOMA: Responde siempre en español formal y directo."
)
SOURCES_HEAD = "--- DOCUMENTOS Y CONTEXTO FUENTE ---\n\n"
SOURCES_FOOT = "------------------------------------\n\n"
QUESTION_HEAD = "PREGUNTA DEL ANALISTA: "
ANSWER_HEAD = "\n\nRESPUESTA EJECUTIVA (con citas y cifras verificadas):"
# Model files by the name parts that select them, first hit wins.
MODEL_FILES = (
    (("2.5", "3b"), "qwen2.5-3b-instruct-q4_k_m.gguf"),
    (("3.8-2b", "2b"), "Qwen3.8-2B-Q4_K_M.gguf"),
    (("3.8-4b", "4b"), "Qwen3.8-4B-Q4_K_M.gguf"),
)


def context_block(citation: Column, fragment: Column, content: Column) -> Column:
    """One source for the prompt; its best chunk is shown first when there is one."""
    lead = F.when(fragment.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("[fragmento relevante: "), fragment, F.lit("]\n")))
    return F.concat(F.lit("DOCUMENTO: "), citation, F.lit("\nCONTENIDO:\n"), lead, content)


def context_prompt(blocks: Column, question: Column) -> Column:
    """User prompt: numbered sources, then the question."""
    numbered = F.transform(blocks, lambda b, i: F.concat(
        F.lit("### FUENTE ["), (i + 1).cast("string"), F.lit("]\n"), b, F.lit("\n\n")))
    return F.concat(F.lit(SOURCES_HEAD), F.array_join(numbered, ""), F.lit(SOURCES_FOOT),
                    F.lit(QUESTION_HEAD), question, F.lit(ANSWER_HEAD))


def model_file(name: str) -> str:
    """Model file for a short model name; an unknown name is returned unchanged."""
    low = name.lower()
    for parts, file in MODEL_FILES:
        if any(part in low for part in parts):
            return file
    return name
