"""Numeric grounding of answers: verdict, strike-out and correction prompts, all in-row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions import numeric as N
from groundline.functions.text import let

# Small whole numbers are always allowed.
FREE_NUMBERS = " ".join(str(i) for i in range(11))
UNVERIFIED_NOTE = "[⚠️ Cifra no verificada en fuentes]"


def allowed_numbers(context: Column, question: Column) -> Column:
    """Sorted raw numbers an answer may use: context, question, their years, and 0 to 10."""
    parts = [N.raw_numbers(context), N.raw_numbers(question), N.years(context), N.years(question)]
    return F.array_sort(F.array_distinct(F.concat(*parts, F.split(F.lit(FREE_NUMBERS), " "))))


def is_money_grounded(m: Column, allowed_money: Column, allowed_raw: Column) -> Column:
    """Same currency in the sources asks for the exact amount; otherwise the digits suffice."""
    same_currency = F.exists(allowed_money, lambda a: a["currency"] == m["currency"])
    same_amount = F.exists(
        allowed_money, lambda a: (a["currency"] == m["currency"]) & (a["value"] == m["value"]))
    return F.when(same_currency, same_amount).otherwise(F.array_contains(allowed_raw, m["base_digits"]))


def is_percent_grounded(p: Column, allowed_percent: Column, allowed_raw: Column) -> Column:
    return F.array_contains(allowed_percent, p["canon"]) | F.array_contains(allowed_raw, p["base_digits"])


VERDICT = ["is_valid", "allowed_numbers", "response_numbers", "hallucinated_numbers", "hallucinated_money",
           "hallucinated_percent"]


def verify(df: DataFrame, response: str = "response", context: str = "context",
           question: str = "question") -> DataFrame:
    """Add the verdict columns to (response, context, question) rows. Nothing is shuffled.

    Phrases are judged first and shield their own digits; the other numbers are judged after.
    """
    r, c, q = F.col(response), F.col(context), F.col(question)
    staged = df.withColumns({
        "allowed_numbers": allowed_numbers(c, q),
        "__allowed_money": F.concat(N.money_phrases(c), N.money_phrases(q)),
        "__allowed_percent": F.transform(
            F.concat(N.percent_phrases(c), N.percent_phrases(q)), lambda p: p["canon"]),
        "response_numbers": F.array_sort(N.raw_numbers(r)),
        "__money": N.money_phrases(r),
        "__percent": N.percent_phrases(r),
    })
    raw = F.col("allowed_numbers")
    money_ok = lambda m: is_money_grounded(m, F.col("__allowed_money"), raw)
    percent_ok = lambda p: is_percent_grounded(p, F.col("__allowed_percent"), raw)
    judged = staged.withColumns({
        "hallucinated_money": F.filter("__money", lambda m: ~money_ok(m)),
        "hallucinated_percent": F.filter("__percent", lambda p: ~percent_ok(p)),
        "__shielded": F.concat(
            F.transform(F.filter("__money", money_ok), lambda m: m["base_digits"]),
            F.transform(F.filter("__percent", percent_ok), lambda p: p["base_digits"])),
    }).withColumn("hallucinated_numbers", F.array_except(
        F.array_except("response_numbers", "allowed_numbers"), F.col("__shielded")))
    valid = (F.size("hallucinated_numbers") + F.size("hallucinated_money") + F.size("hallucinated_percent")) == 0
    return judged.withColumn("is_valid", valid).select(*df.columns, *VERDICT)


def _struck(raw: Column) -> Column:
    return F.concat(F.lit("~~"), raw, F.lit(f"~~ {UNVERIFIED_NOTE}"))


def _mark_phrases(text: Column, phrases: Column, first_mark: str) -> Column:
    """Replace each phrase by a private-use tag, so later steps leave it alone."""
    return F.aggregate(
        F.transform(phrases, lambda p, i: F.struct(p["raw_text"].alias("raw"), i.alias("i"))), text,
        lambda acc, p: F.when(p["raw"] == "", acc).otherwise(
            F.replace(acc, p["raw"], _mark(first_mark, p["i"]))))


# Private-use characters that stand for phrases while a text is worked on: two kinds of mark, the end of a mark, ten
# digits, and the escape for texts that hold such characters themselves.
_MONEY_MARK, _PERCENT_MARK, _MARK_END, _ESCAPE = "\ue000", "\ue001", "\ue002", "\ue003"
_DIGITS = "".join(chr(0xE010 + n) for n in range(10))


def _mark(first: str, i: Column) -> Column:
    """Tag of phrase number ``i``."""
    return F.concat(F.lit(first), F.translate(i.cast("string"), "0123456789", _DIGITS), F.lit(_MARK_END))


def _escaped(text: Column) -> Column:
    """``text`` without marks: the escape character comes first, so that undoing it is unique."""
    for n, c in enumerate((_ESCAPE, _MONEY_MARK, _PERCENT_MARK)):
        text = F.replace(text, F.lit(c), F.lit(_ESCAPE + _DIGITS[n]))
    return text


def _unescaped(text: Column) -> Column:
    for n, c in reversed(list(enumerate((_ESCAPE, _MONEY_MARK, _PERCENT_MARK)))):
        text = F.replace(text, F.lit(_ESCAPE + _DIGITS[n]), F.lit(c))
    return text


def strike_out(text: Column, numbers: Column, money: Column, percent: Column, strict: bool = False) -> Column:
    """Strike what is not grounded: whole amounts, whole percentages, then bare numbers.

    A bare number is struck where a complete number token has its digits. ``strict`` replaces the
    digit string wherever it occurs instead, so formatted numbers stay and inner digits may go.
    """
    marked = _mark_phrases(_mark_phrases(_escaped(text), money, _MONEY_MARK), percent, _PERCENT_MARK)
    if strict:
        numbered = F.aggregate(F.array_sort(numbers), marked, lambda acc, n: F.replace(acc, n, _struck(n)))
    else:
        def rebuild(body: Column) -> Column:
            tokens = F.concat(F.regexp_extract_all(body, F.lit(N.RAW_NUMBER), F.lit(0)), F.array(F.lit("")))
            shown = F.transform(tokens, lambda t: F.when(
                F.array_contains(numbers, N.digits_only(t)), _struck(t)).otherwise(t))
            return F.array_join(F.zip_with(
                F.split(body, N.RAW_NUMBER, -1), shown, lambda gap, t: F.concat(gap, t)), "")

        numbered = let(marked, rebuild)

    def restore(body: Column, phrases: Column, mark: str) -> Column:
        return F.aggregate(
            F.transform(phrases, lambda p, i: F.struct(p["raw_text"].alias("raw"), i.alias("i"))), body,
            lambda acc, p: F.replace(acc, _mark(mark, p["i"]), _struck(p["raw"])))

    return _unescaped(restore(restore(numbered, money, _MONEY_MARK), percent, _PERCENT_MARK))


# The four kinds of correction.
UNKNOWN, CURRENCY, NOTATION, IN_CORPUS = "NoEspecificado", "Moneda", "Representacion", "EnCorpus"
PROMPT_CORRECTIONS = 5
CORRECTION_MARK = "Tu respuesta anterior incluyó cifras NO verificadas"
AUDIT_MARK = "AUDITORÍA NUMÉRICA"


def is_echo(response: Column) -> Column:
    """True when an answer repeats the correction prompt."""
    return response.contains(CORRECTION_MARK) | response.contains(AUDIT_MARK)


def correction_prompt(corrections: Column, attempt: Column | int, retries: int) -> Column:
    """Retry instruction that lists at most five corrections."""
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt

    def line(c: Column) -> Column:
        name = c["hallucinated"]
        source = F.coalesce(c["source"], F.lit(""))
        return (
            F.when(c["kind"] == UNKNOWN, F.format_string(
                "  - '%s': no existe en ningún documento → responde '[Dato no especificado en las fuentes]'.", name))
            .when(c["kind"] == CURRENCY, F.format_string(
                "  - '%s': la moneda es incorrecta. El dato correcto en el documento es '%s' [%s].",
                name, F.coalesce(c["suggested_value"], F.lit("")), source))
            .when(c["kind"] == NOTATION, F.format_string(
                "  - '%s': usa la cifra literal del documento [%s]. NO la conviertas ni cambies el formato.",
                name, source))
            .otherwise(F.format_string(
                "  - '%s': la cifra existe en [%s] pero verifica a qué concepto corresponde "
                "(posible atribución errónea).", name, F.coalesce(c["source"], F.lit("el contexto recuperado"))))
        )

    head = F.array(
        F.format_string(f"\n\n🚨 [{AUDIT_MARK} - REINTENTO %d/{retries}]:", attempt),
        F.lit(f"{CORRECTION_MARK}:"))
    tail = F.array(F.lit(
        "INSTRUCCIÓN: copia literalmente las cifras verificadas con su moneda y formato del documento; "
        "NO conviertas ni inventes."))
    shown = F.transform(F.slice(corrections, 1, PROMPT_CORRECTIONS), line)
    return F.array_join(F.concat(head, shown, tail), "\n")
