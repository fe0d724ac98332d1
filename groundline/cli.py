"""Command line: ingest, query, benchmark, and an interactive prompt.

Results go to stdout; progress and warnings go to stderr, so ``--json`` output stays parseable.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.connectors.http import ChatClient, EmbeddingClient
from groundline.functions.prompts import model_file
from groundline.operators.grounding import CURRENCY, IN_CORPUS, verify
from groundline.operators.index import TextIndex
from groundline.plans.answering import Telemetry, answer, context_of
from groundline.plans.ingest import load_or_build
from groundline.plans.retrieval import DEFAULT_K, one_question, retrieve
from groundline.session import cut_lineage, local_session
from groundline.sources.corpus import Corpus
from groundline.sources.vectors import align_by_position, read_vector_file

# The benchmark questions and their issuer filters.
BENCHMARK = (
    ("¿Cuántos camiones de minería entregó Ferreycorp en 2025 y qué ratio de deuda reportó?", "Ferreycorp"),
    ("¿Cuál fue el ROE y el margen operativo de Ferreycorp en 2025?", "Ferreycorp"),
    ("¿Cuáles fueron los principales factores macroeconómicos y de pobreza según el Banco Mundial?", "WorldBank"),
    ("¿Cuál fue la utilidad neta y el nivel de provisiones reportado por Financiera Efectiva?", "Financiera"),
    ("¿Qué proyectos de inversión y capex se ejecutaron en el periodo 2024-2025?", None),
)
PROBE_CONTEXT = "Las ventas de 2025 fueron 59968 unidades y la deuda fue 1400 millones."
PROBES = ("En 2025 se vendieron 59968 unidades.", "En 2025 se vendieron 99999 unidades.")


def say(text: str) -> None:
    print(text, file=sys.stderr, flush=True)


@dataclass
class Engine:
    spark: SparkSession
    corpus: Corpus
    index: TextIndex
    vectors: DataFrame | None
    chat: ChatClient
    embedder: EmbeddingClient | None
    options: argparse.Namespace

    def retrieve(self, question: str, issuer: str | None, vector=None) -> DataFrame:
        asked = one_question(self.spark, question, issuer, vector)
        return retrieve(asked, self.corpus.parents, self.corpus.children, self.index, self.options.top_k, self.vectors)

    def question_vector(self, question: str):
        """The question's vector, or None with a warning when the endpoint fails."""
        if self.embedder is None:
            return None
        try:
            return self.embedder.embed_query(question)
        except (OSError, ValueError) as error:
            say(f"no embeddings: {error}")
            return None

    def report(self, question: str, issuer: str | None) -> dict:
        """Everything known about one question, in the shape of the JSON report."""
        start = time.perf_counter()
        blocks = cut_lineage(self.retrieve(question, issuer, self.question_vector(question)))
        elapsed = (time.perf_counter() - start) * 1000
        asked = context_of(blocks, self.corpus.children, one_question(self.spark, question, issuer)).select(
            "query_id", "question", "context", F.transform("sources", lambda s: s.dropFields("text", "rank")).alias("parts"))
        row = asked.first()
        if row is None:
            return {"ok": False, "question": question, "error": "No se encontraron documentos relevantes"}
        parts = [part.asDict(recursive=True) for part in row["parts"]]
        base = {"question": question, "issuer_filter": issuer, "retrieval_ms": elapsed,
                "sources": [p["citation"] for p in parts], "parent_sources": parts}
        if not self.chat.is_healthy():
            return {"ok": False, **base, "error": "llama-server no responde"}
        telemetry, start = Telemetry(), time.perf_counter()
        try:
            result = answer(asked.select("query_id", "question", "context"), self.chat,
                            children=self.corpus.children, index=self.corpus.number_index,
                            strict_attribution=self.options.strict_attribution, telemetry=telemetry).drop("query_id", "question").first()
        except Exception as error:  # the report carries the failure
            return {"ok": False, **base, "error": str(error)}
        times = {"latency_ms": (time.perf_counter() - start) * 1000, "model_ms": telemetry.model_ms,
                 "guardrail_latency_micros": telemetry.check_micros, "rounds": telemetry.rounds}
        return {"ok": True, **base, "guardrail": result.asDict(recursive=True) | times}


def readable(report: dict) -> str:
    """The report for people."""
    out = [f"PREGUNTA: {report['question']}"]
    if report.get("issuer_filter"):
        out.append(f"FILTRO EMISOR: {report['issuer_filter']}")
    if "retrieval_ms" in report:
        out.append(f"TIEMPO RETRIEVAL HÍBRIDO: {report['retrieval_ms']:.2f} ms "
                   f"({len(report['sources'])} parents recuperados)")
        out.append("FUENTES Y CITAS ENCONTRADAS:")
        out += [f"  [{i}] {p['citation']} (Score RRF: {p['score']:.4f})"
                for i, p in enumerate(report["parent_sources"], 1)]
    if not report["ok"]:
        return "\n".join([*out, f"AVISO: {report['error']}"])
    g = report["guardrail"]
    out += ["RESPUESTA EJECUTIVA:", g["final_response"], "REPORTE DE AUDITORÍA:"]
    if g["is_valid"]:
        out.append("  Estado: VALIDADO (100% cifras respaldadas)")
    else:
        out.append("  Estado: ADVERTENCIA (Cifras dudosas detectadas y saneadas)")
        out.append(f"  Cifras no verificadas: {g['hallucinated_numbers']}")
        if g["hallucinated_money"]:
            out.append(f"  Frases monetarias no verificadas: {g['hallucinated_money']}")
        for c in g["corrections"]:
            if c["kind"] == CURRENCY:
                out.append(f"  Corrección sugerida: {c['hallucinated']} → {c['suggested_value']} [{c['source']}]")
            elif c["kind"] == IN_CORPUS:
                out.append(f"  Atribución: '{c['hallucinated']}' existe en [{c['source'] or 'contexto'}]")
    for f in g["attribution"]:
        amount = f"{f['claimed_currency']} {f['claimed_value']}"
        if f["is_misattribution"]:
            hint = f" Valor único en el corpus: {f['correct_value']}" if f["correct_value"] else ""
            out.append(f"  Mala atribución: '{amount}' para '{f['indicator']}' en '{f['issuer']}'.{hint}")
        if f["segment_qualifier"]:
            out.append(f"  Segmento vs. totales: '{amount}' de '{f['indicator']}' en '{f['issuer']}'.")
    out.append(f"  Intentos: {g['attempts']} (Auto-corregido: {'SÍ' if g['auto_corrected'] else 'NO'})")
    out.append(f"  Tiempo LLM Total: {g['latency_ms']:.2f} ms")
    out.append(f"  Latencia Validación Numérica: {g['guardrail_latency_micros']} µs")
    return "\n".join(out)


def benchmark(engine: Engine) -> dict:
    """Time the fixed questions one by one, then a grounded and an ungrounded answer."""
    times = []
    for number, (question, issuer) in enumerate(BENCHMARK, 1):
        start = time.perf_counter()
        rows = engine.retrieve(question, issuer).select("citations", "score").collect()
        times.append((time.perf_counter() - start) * 1000)
        say(f"[{number}/{len(BENCHMARK)}] {question}: {len(rows)} pages, {times[-1]:.0f} ms")
    probes = engine.spark.createDataFrame(
        [(p, PROBE_CONTEXT, "¿Ventas 2025?") for p in PROBES], "response string, context string, question string")
    verdicts = {r["response"]: r for r in verify(probes).collect()}
    return {"mean_retrieval_ms": sum(times) / len(times), "retrieval_ms": times, "grounded_valid": verdicts[PROBES[0]]["is_valid"],
            "ungrounded_numbers": verdicts[PROBES[1]]["hallucinated_numbers"]}


def show(engine: Engine, question: str, issuer: str | None) -> None:
    report = engine.report(question, issuer)
    print(json.dumps(report, ensure_ascii=False, indent=2, default=str) if engine.options.json else readable(report))


def interactive(engine: Engine, issuer: str | None, read=input) -> None:
    """Prompt until :exit. ``:filter NAME`` and ``:clear`` set the issuer, ``:bench`` runs the benchmark."""
    say(":filter <EMISOR>  :clear  :bench  :exit")
    while True:
        try:
            line = read(f"[{issuer or 'Todos'}] > ").strip()
        except EOFError:
            return
        low = line.lower()
        if low in (":exit", ":quit", "exit"):
            return
        if line.startswith(":filter "):
            issuer = line.removeprefix(":filter ").strip() or None
        elif low == ":clear":
            issuer = None
        elif low == ":bench":
            print(json.dumps(benchmark(engine), ensure_ascii=False))
        elif line:
            show(engine, line, issuer)


def global_options() -> argparse.ArgumentParser:
    """Options that may stand before or after the command."""
    shared = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    shared.add_argument("--json", action="store_true", help="print JSON reports")
    shared.add_argument("--strict-attribution", action="store_true",
                        help="a segment figure given as a total invalidates the answer")
    shared.add_argument("--embeddings-url")
    shared.add_argument("--embeddings-bin")
    return shared


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="groundline", parents=[global_options()])
    p.add_argument("-q", "--query")
    p.add_argument("--reindex", action="store_true")
    p.add_argument("-f", "--filter-issuer")
    p.add_argument("-m", "--model", default="")
    p.add_argument("--api-base", default="http://127.0.0.1:8080")
    p.add_argument("-k", "--top-k", type=int, default=DEFAULT_K)
    p.add_argument("--data-dir", default="data")
    p.add_argument("--store", help="folder for the corpus and index (default: the data folder)")
    p.add_argument("-t", "--temperature", type=float, default=0.1)
    p.add_argument("--benchmark", action="store_true")
    p.set_defaults(json=False, strict_attribution=False, embeddings_url="", embeddings_bin="")
    commands = p.add_subparsers(dest="command")
    ingest = commands.add_parser("ingest", parents=[global_options()])
    ingest.add_argument("--data-dir", dest="ingest_dir", default=None)
    ingest.add_argument("--force", action="store_true", default=True)
    query = commands.add_parser("query", parents=[global_options()])
    query.add_argument("question")
    query.add_argument("-i", "--issuer")
    commands.add_parser("benchmark", parents=[global_options()])
    return p


def open_engine(spark: SparkSession, options: argparse.Namespace) -> Engine:
    store = options.store or options.data_dir
    corpus, index = load_or_build(spark, options.data_dir, store, options.reindex)
    vectors = embedder = None
    if options.embeddings_url:
        embedder = EmbeddingClient(options.embeddings_url)
        path = options.embeddings_bin or f"{options.data_dir}/embeddings.bin"
        try:
            vectors = cut_lineage(align_by_position(corpus.children, read_vector_file(spark, path)))
        except (OSError, ValueError) as error:
            say(f"no vectors ({error}); two text rankers only")
    chat = ChatClient(options.api_base, model_file(options.model), options.temperature)
    return Engine(spark, corpus, index, vectors, chat, embedder, options)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    options = parser().parse_args(argv)
    spark = spark or local_session()
    if options.command == "ingest":
        folder = options.ingest_dir or options.data_dir
        corpus, _ = load_or_build(spark, folder, options.store or folder, options.force)
        say(f"{corpus.parents.count()} parents, {corpus.children.count()} children, "
            f"{corpus.number_index.select('number').distinct().count()} numbers")
        return
    engine = open_engine(spark, options)
    if options.benchmark or options.command == "benchmark":
        print(json.dumps(benchmark(engine), ensure_ascii=False))
    elif options.command == "query":
        show(engine, options.question, options.issuer or options.filter_issuer)
    elif options.query:
        show(engine, options.query, options.filter_issuer)
    else:
        interactive(engine, options.filter_issuer)


if __name__ == "__main__":
    main()
