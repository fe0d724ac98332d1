"""Text scalar functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD_FROM = "áÁéÉíÍóÓúÚüÜ" + _UPPER
_FOLD_TO = "aaeeiioouuuu" + _UPPER.lower()
# The folds that lower-cased texts still need.
LOWER_FOLDS = tuple(zip("áéíóúü", "aeiouu"))

# After folding only lower-case letters are left, plus the upper-case forms that have no fold.
_LONG_CHARS = "áéíóúüñÑſK"
_WORD_CHARS = f"a-z0-9.%/{_LONG_CHARS}"
# Letters and digits only, as a full-text analyser cuts them.
ANALYSED_PATTERN = r"[\p{IsAlphabetic}\p{N}]+"

_PIPE_ROW = r"(?dU)^\s*\|.*\|\s*$"
_MERGED_HEADER = (
    r"(?dmU)^\|\s*(.+?)\s+([A-ZÁÉÍÓÚÑ]{4,}(?:\s+(?:Y|E|DE|DEL|EN|[A-ZÁÉÍÓÚÑ]{2,}))*)"
    r"\s*\|\s*(?:([\d.,\s\-|]*[\d.,\-|])\s*|\s+)$"
)
_LONE_HEADER = (
    r"(?dmU)^\|\s*([A-ZÁÉÍÓÚÑ]{4,}(?:\s+(?:Y|E|DE|DEL|EN|[A-ZÁÉÍÓÚÑ]{2,}))*)\s*\|\s*\|\s*\|$"
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(c: Column) -> Column:
    """Search form: Spanish accents folded, ASCII lower-cased; ñ and Ñ are kept as they are."""
    return F.translate(c, _FOLD_FROM, _FOLD_TO)


# What a pattern's ``\s`` matches under ``(?U)``.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def word_pattern(stopwords) -> str:
    """Whole runs of word characters that are no stopword and at least two bytes long."""
    run = f"[{_WORD_CHARS}]"
    stop = "|".join(sorted(stopwords))
    return f"(?<!{run})(?!(?:{stop})(?!{run}))(?:{run}{{2,}}|[{_LONG_CHARS}])"


def words(c: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """Search tokens of a text: at least two bytes long and no stopword, repeats kept."""
    if not all(re.fullmatch(f"[{_WORD_CHARS}]+", stop) for stop in dictionary.stopwords):
        return F.regexp_extract_all(normalize(c), F.lit(word_pattern(dictionary.stopwords)), F.lit(0))
    # whole runs are cut by a plain class and judged after: a third of the pattern's time
    runs = F.regexp_extract_all(normalize(c), F.lit(f"[{_WORD_CHARS}]+"), F.lit(0))
    return F.filter(runs, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*sorted(dictionary.stopwords)))


def analysed_terms(c: Column, max_bytes: int | None = None) -> Column:
    """Full-text terms: alphanumeric runs, lower-cased; runs of ``max_bytes`` or more are dropped if it is given."""
    found = F.regexp_extract_all(F.lower(normalize(c)), F.lit(ANALYSED_PATTERN), F.lit(0))
    return found if max_bytes is None else F.filter(found, lambda t: F.octet_length(t) < max_bytes)


def analysed_text(c: Column) -> Column:
    """Lower-cased text: its runs of ASCII letters, ASCII digits and all characters beyond ASCII are :func:`analysed_terms`
    once ``LOWER_FOLDS`` are applied. Tasks cut it by bytes, several times faster than a pattern cuts each term."""
    return F.regexp_replace(F.lower(c), r"[^\x00-\x7F\p{IsAlphabetic}\p{N}]", " ")


def table(rows, schema: str) -> Column:
    """A small lookup table as one literal, for use inside a row expression."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), schema)


def lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def pipe_rows(c: Column) -> Column:
    """Trimmed Markdown table rows of a text, in order."""
    return F.filter(F.transform(lines(c), strip), lambda s: s.rlike(_PIPE_ROW))


def is_pipe_table(c: Column) -> Column:
    return c.contains("|") & (F.size(pipe_rows(c)) >= 2)


def sanitize_tables(c: Column) -> Column:
    """Put an upper-case section name that was merged into a row label on a row of its own."""
    split_rows = F.regexp_replace(c, _MERGED_HEADER, "| **$2** |||\n| $1 | $3")
    return F.regexp_replace(split_rows, _LONE_HEADER, "| **$1** |||")


def is_contents_page(c: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """True for a table of contents: an explicit marker, or mostly table lines without figures."""
    pattern = "|".join(rf"\Q{marker}\E" for marker in dictionary.contents_markers)

    def judge(full: Column) -> Column:
        marked = F.filter(full, lambda s: s.startswith("|") | s.startswith("#"))
        named = F.exists(marked, lambda s: normalize(s).rlike(pattern))
        dense = F.size(marked) / F.size(full) >= 0.6
        short = F.length(c) < 800
        few_digits = F.length(F.regexp_replace(c, "[^0-9]", "")) < 10
        return (F.size(full) >= 3) & (named | (dense & short & few_digits))

    return let(F.filter(F.transform(lines(c), strip), lambda s: s != ""), judge)


def figure_overlap(question_words: Column, content: Column,
                   dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """Fragments of ``content`` that hold a digit and share a word with the question."""
    fragments = F.filter(F.split(content, r"[.\n]"), lambda s: s.rlike("[0-9]"))
    return F.size(F.filter(fragments, lambda s: F.arrays_overlap(words(s, dictionary), question_words)))


def clauses(c: Column) -> Column:
    """Cut a question at punctuation and at the conjunction " y "."""
    parts = F.transform(F.split(c, r"[,;\n¿?.]| y "), strip)
    return F.filter(parts, lambda s: s != "")


def segments(c: Column) -> Column:
    """Like :func:`clauses`, but a full stop does not cut."""
    parts = F.transform(F.split(c, r"[,;\n¿?]| y "), strip)
    return F.filter(parts, lambda s: s != "")


def is_preamble(clause: Column, issuer: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """True when a clause names little more than the issuer and the kind of document."""
    rest = F.replace(normalize(clause), normalize(issuer), F.lit(""))
    doc_words = F.split(F.lit(" ".join(dictionary.document_words)), " ")
    return F.size(F.filter(words(rest, dictionary), lambda t: ~F.array_contains(doc_words, t))) <= 1


def proper_names(clause: Column, issuer: Column) -> Column:
    """Capitalised words of a clause (not the first, not the issuer) in search form, distinct."""
    tokens = F.split(strip(clause), r"(?U)\s+")
    named = F.filter(tokens, lambda t, i: (i > 0) & t.rlike(r"^\p{IsUppercase}"))
    edge = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"
    folded = F.transform(named, lambda t: normalize(F.regexp_replace(t, edge, "")))
    return F.array_distinct(F.filter(folded, lambda t: (t != "") & (t != normalize(issuer))))


def strip_reasoning(c: Column) -> Column:
    """Remove reasoning blocks, then a dangling closing tag with all that precedes it."""
    for tag in ("think", "thought", "reasoning"):
        c = F.regexp_replace(c, rf"(?isU)<{tag}>.*?</{tag}\s*>", "")
    return strip(F.regexp_replace(c, r"(?isU)\A.*?</think\s*>", ""))


def has_word(lowered: Column, word: str) -> Column:
    """Whole-word test with ASCII letters and digits as word characters."""
    return lowered.rlike(rf"(?<![0-9A-Za-z])\Q{word}\E(?![0-9A-Za-z])")


def sentences(c: Column, strict: bool = False) -> Column:
    """Cut an answer into sentences without breaking decimals or the currency sign ``S/.``.

    ``strict`` also refuses to cut after any word that ends in s.
    """
    keep = r"(?<![/sS]\.)" if strict else r"(?<![sS]/\.)(?:(?<![sS]\.)|(?![0-9]))"
    full_stop = r"(?<=\.)" + keep + r"(?:(?<![0-9]\.)|(?![0-9]))"
    pieces = F.split(c, r"(?<=[?!\n\r])|" + full_stop)
    pieces = F.filter(F.transform(pieces, strip), lambda s: s != "")

    def merge(done: Column, piece: Column) -> Column:
        joined = F.concat(F.element_at(done, -1), F.lit(" "), piece)
        head = F.slice(done, F.lit(1), F.size(done) - 1)
        return F.when(
            piece.rlike(r"\p{IsAlphabetic}") | (F.size(done) == 0), F.concat(done, F.array(piece))
        ).otherwise(F.concat(head, F.array(joined)))

    return F.aggregate(pieces, F.array().cast("array<string>"), merge)


def issuer_key(c: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    """Canonical key of a written issuer name."""
    flat = F.regexp_replace(F.lower(strip(c)), "[_\\- ]", "")
    key = flat
    for canon, fragments in reversed(dictionary.issuer_name_rules):
        key = F.when(flat.rlike("|".join(fragments)), F.lit(canon)).otherwise(key)
    return key


def keys_match(doc_key: Column, filter_key: Column) -> Column:
    """Containment either way on canonical keys; no filter lets everything pass."""
    return (
        filter_key.isNull()
        | (filter_key == "")
        | F.contains(doc_key, filter_key)
        | F.contains(filter_key, doc_key)
    )


def issuer_matches(doc_issuer: Column, wanted: Column, dictionary: Dictionary = DEFAULT_DICTIONARY) -> Column:
    return keys_match(issuer_key(doc_issuer, dictionary), issuer_key(wanted, dictionary))
