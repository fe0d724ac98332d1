"""Answer questions with a language model and correct the answers against their sources."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions.numeric import MONEY_TYPE, PERCENT_TYPE, money_key
from groundline.functions.prompts import SYSTEM_PROMPT, context_block, context_prompt
from groundline.functions.text import strip_reasoning
from groundline.operators import attribution as A
from groundline.operators import grounding as G
from groundline.operators.corrections import CORRECTION, find_corrections
from groundline.session import broadcast_if_small, cut_lineage, prune_scan

DEFAULT_RETRIES = 3
FINDINGS = ("array<struct<indicator:string,issuer:string,claimed_currency:string,claimed_value:string,"
            "correct_value:string,segment_qualifier:boolean,is_misattribution:boolean>>")
CORRECTIONS = ("array<struct<kind:string,hallucinated:string,suggested_value:string,source:string,"
               "snippet:string>>")
LOG = ("array<struct<attempt:int,is_valid:boolean,hallucinated_numbers:array<string>,"
       "hallucinated_money:array<string>,corrections_sent:array<string>>>")
STATE = {
    "prompt": "string", "raw_response": "string", "answer": "string", "done": "boolean", "is_valid": "boolean",
    "attempts": "int", "seen": "string", "numbers": "array<string>", "money": MONEY_TYPE, "percent": PERCENT_TYPE,
    "corrections": CORRECTIONS, "attribution": FINDINGS, "attempt_log": LOG, "auto_corrected": "boolean",
}


@dataclass
class Telemetry:
    """What :func:`answer` measures of a batch: time spent on replies and on checking figures, and counts of each round."""

    model_ms: float = 0.0
    check_micros: int = 0
    rounds: list[dict[str, int]] = field(default_factory=list)

    def counting(self, rows: DataFrame) -> tuple[DataFrame, Observation]:
        """``rows`` of a round, observed on their way to the checkpoint: no pass of its own."""
        seen = Observation()
        count = lambda condition, name: F.count_if(condition).alias(name)
        return rows.observe(
            seen, F.count(F.lit(1)).alias("answers"), count(F.col("is_valid"), "valid"), count(~F.col("done"), "open"),
            F.coalesce(F.sum(F.size("numbers") + F.size("money") + F.size("percent")), F.lit(0)).alias("figures"),
            F.coalesce(F.sum(F.size("corrections")), F.lit(0)).alias("corrections")), seen


def context_of(blocks: DataFrame, children: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, question, context, sources) from retrieved pages; at most k pages per question."""
    first = F.get("matched_child_ids", F.lit(0))
    rows = cut_lineage(blocks.withColumn("child_id", first))
    wanted = broadcast_if_small(rows.where("child_id IS NOT NULL").select("child_id").distinct())
    lead = prune_scan(children, "child_id", wanted).join(wanted, "child_id").select(
        "child_id", F.col("content").alias("fragment"))
    cited = rows.join(lead, "child_id", "left").withColumn("citation", F.get("citations", F.lit(0)))
    text = context_block(F.col("citation"), F.col("fragment"), F.col("content"))
    source = F.struct(
        "rank", "citation", F.col("block_id").alias("parent_id"), "page", "score", "matched_child_ids",
        F.length("content").alias("content_chars"), text.alias("text"))
    merged = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    return questions.select("query_id", "question", "issuer_filter").join(merged, "query_id").withColumn(
        "context", F.array_join(F.transform("sources", lambda s: s["text"]), "\n\n"))


def _generate(rows: DataFrame, model: Callable[[str, str], str], system: str) -> DataFrame:
    """Ask the model for every open row, inside tasks."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda prompt: model(system, prompt))

    return rows.withColumn("reply", strip_reasoning(ask(F.col("prompt"))))


def _start(questions: DataFrame) -> DataFrame:
    prompt = context_prompt(F.array(F.col("context")), F.col("question"))
    first = {name: F.lit(None).cast(kind) for name, kind in STATE.items()}
    first |= {"prompt": prompt, "done": F.lit(False), "is_valid": F.lit(False), "attempts": F.lit(0),
              "auto_corrected": F.lit(False)}
    first |= {name: F.array().cast(STATE[name]) for name in (
        "numbers", "money", "percent", "corrections", "attribution", "attempt_log")}
    return questions.select("query_id", "question", "context", *[c.alias(n) for n, c in first.items()])


def _attribution_lines(found, strict: bool):
    """Retry lines for amounts given to the wrong issuer or indicator."""
    def line(f):
        only = F.when(f["correct_value"].isNull(), F.lit(" (hay varios valores posibles, no inventes el correcto)"))
        only = only.otherwise(F.concat(F.lit(". El único valor en el corpus es '"), f["correct_value"], F.lit("'")))
        wrong = F.concat(F.format_string(
            "\n  - ⚠ ATRIBUCIÓN: verifica la atribución del indicador '%s' en el emisor '%s': la cifra '%s %s' no "
            "aparece en el documento para ese indicador",
            f["indicator"], f["issuer"], f["claimed_currency"], f["claimed_value"]), only)
        segment = F.format_string(
            "\n  - ⚠ SEGMENTO: la cifra '%s %s' de '%s' en '%s' pertenece a un segmento de negocio (ej. gran "
            "minería), NO a los totales. No la reportes como total.",
            f["claimed_currency"], f["claimed_value"], f["indicator"], f["issuer"])
        return F.when(f["is_misattribution"], wrong).when(F.lit(strict) & f["segment_qualifier"], segment).otherwise("")

    return F.array_join(F.transform(found, line), "")


def _collected(rows: DataFrame, fields: list[str], order: list[str], name: str) -> DataFrame:
    """Rows of one answer as an ordered array; their number is bounded by the answer's length."""
    packed = F.struct(*order, F.struct(*fields).alias("item"))
    return rows.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["item"]).alias(name))


def _round(open_rows: DataFrame, attempt: int, retries: int, model, system, amounts, index, strict_attribution,
           strict, dictionary, telemetry: Telemetry) -> DataFrame:
    """One attempt for all open questions."""
    start = time.perf_counter()
    asked = cut_lineage(_generate(open_rows, model, system))
    telemetry.model_ms += (time.perf_counter() - start) * 1000
    echo = G.is_echo(F.col("reply"))
    # An echo of the correction prompt is no answer: the previous answer stands, or none.
    judged = asked.withColumn("echo", echo).withColumn("previous", F.col("answer")).withColumn(
        "answer", F.when(~echo, F.col("reply")).when(F.col("previous").isNotNull(), F.col("previous"))
        .otherwise(F.col("reply") if strict else F.lit("")))
    start = time.perf_counter()
    verdicts = cut_lineage(G.verify(judged.drop("is_valid"), "answer").withColumnRenamed("is_valid", "verdict_valid"))
    telemetry.check_micros += round((time.perf_counter() - start) * 1e6)

    found = verdicts.select("query_id", F.array().cast(FINDINGS).alias("found")).limit(0)
    if amounts is not None:
        stated = A.claims(verdicts.where("NOT echo"), ["query_id"], "answer", dictionary, strict)
        found = _collected(A.findings(stated, amounts, ["query_id"]), A.FINDING, ["s_idx", "m_idx"], "found")
    fixes = _collected(find_corrections(verdicts.where("NOT echo"), ["query_id"], index), CORRECTION, ["ord"], "fixes")
    rows = verdicts.join(found, "query_id", "left").join(fixes, "query_id", "left")
    rows = rows.withColumn("found", F.when(F.col("echo"), F.col("attribution")).otherwise(
        F.coalesce("found", F.array().cast(FINDINGS)))).withColumn(
        "fixes", F.when(F.col("echo"), F.col("corrections")).otherwise(
            F.coalesce("fixes", F.array().cast(CORRECTIONS))))

    blamed = F.exists("found", lambda f: f["is_misattribution"] | (F.lit(strict_attribution) & f["segment_qualifier"]))
    sorted_numbers = F.array_sort("hallucinated_numbers")
    money_keys = F.transform("hallucinated_money", money_key)
    seen = F.to_json(F.struct(sorted_numbers.alias("n"), money_keys.alias("m"), F.col("found").alias("f")))
    accepted = ~F.col("echo") & (F.lit(strict) | (F.col("answer") != "")) & F.col("verdict_valid") & ~blamed
    rows = rows.withColumn("now", seen)
    # The same complaints as last time: another attempt would not help.
    rebound = ~F.col("echo") & (F.lit(attempt) > 1) & (F.col("seen") == F.col("now"))
    stop = F.col("echo") | rebound | accepted
    again = ~stop & F.lit(attempt < retries)
    sent = F.struct(
        F.lit(attempt).alias("attempt"), F.lit(False).alias("is_valid"),
        sorted_numbers.alias("hallucinated_numbers"), money_keys.alias("hallucinated_money"),
        F.transform("fixes", lambda c: c["hallucinated"]).alias("corrections_sent"))
    grown = F.concat("prompt", G.correction_prompt(F.col("fixes"), attempt, retries),
                     _attribution_lines(F.col("found"), strict_attribution))
    none = lambda kind: F.array().cast(kind)
    return rows.select(
        "query_id", "question", "context",
        F.when(again, grown).otherwise(F.col("prompt")).alias("prompt"),
        F.col("reply").alias("raw_response"), "answer", ~again, accepted.alias("is_valid"),
        F.lit(attempt).alias("attempts"), F.col("now").alias("seen"),
        F.when(accepted, none("array<string>")).otherwise(sorted_numbers).alias("numbers"),
        F.when(accepted, none(MONEY_TYPE)).otherwise(F.col("hallucinated_money")).alias("money"),
        F.when(accepted, none(PERCENT_TYPE)).otherwise(F.col("hallucinated_percent")).alias("percent"),
        F.when(accepted, none(CORRECTIONS)).when(rebound, F.col("corrections")).otherwise(F.col("fixes"))
        .alias("corrections"),
        F.col("found").alias("attribution"),
        F.when(again, F.concat("attempt_log", F.array(sent))).otherwise(F.col("attempt_log")).alias("attempt_log"),
        (F.col("auto_corrected") | again).alias("auto_corrected"),
    ).toDF("query_id", "question", "context", *STATE)


def answer(questions: DataFrame, model: Callable[[str, str], str], retries: int = DEFAULT_RETRIES,
           children: DataFrame | None = None, index: DataFrame | None = None, strict_attribution: bool = False,
           strict: bool = False, system: str = SYSTEM_PROMPT,
           dictionary: Dictionary = DEFAULT_DICTIONARY, telemetry: Telemetry | None = None) -> DataFrame:
    """Verified answers for (query_id, question, context).

    ``model`` is called inside tasks with (system prompt, user prompt). Each attempt is one pass
    over the questions still open; its replies are written before anything reads them, so a lost
    executor does not ask the model again for finished attempts. ``children`` and ``index`` give the
    corpus side of attribution and corrections. ``strict`` keeps literal digit strike-out and
    sentence rules. ``telemetry`` takes up times and counts of this call.
    """
    telemetry = telemetry or Telemetry()
    retries = max(1, retries)
    amounts = None if children is None else cut_lineage(A.pair_amounts(children, dictionary))
    state = _start(questions)
    finished = None
    for attempt in range(1, retries + 1):
        state, seen = telemetry.counting(_round(state, attempt, retries, model, system, amounts, index,
                                                strict_attribution, strict, dictionary, telemetry))
        state = cut_lineage(state)
        telemetry.rounds.append(dict(seen.get))
        closed = state.where("done")
        finished = closed if finished is None else finished.unionByName(closed)
        state = state.where("NOT done")
        if attempt < retries and state.isEmpty():
            break
    no_phrases = F.array().cast(MONEY_TYPE), F.array().cast(PERCENT_TYPE)
    clean = (G.strike_out(F.col("answer"), F.col("numbers"), *no_phrases, strict=True) if strict else
             G.strike_out(F.col("answer"), F.col("numbers"), F.col("money"), F.col("percent")))
    return finished.select(
        "query_id", "question", "raw_response",
        F.when(F.col("is_valid"), F.col("answer")).otherwise(clean).alias("final_response"), "is_valid", "attempts",
        F.col("numbers").alias("hallucinated_numbers"),
        F.transform("money", money_key).alias("hallucinated_money"),
        F.transform("percent", lambda p: p["canon"]).alias("hallucinated_percent"),
        "corrections", "attempt_log", "auto_corrected", "attribution")
