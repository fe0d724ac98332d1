"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the reply, which alone is
trainable. Turns stand between control strings; control strings inside texts and roles get one more backslash after
their first character, which is undone on reading. A conversation that doesn't end with an assistant turn has one more
example without a trainable part, so that the formatted output keeps every turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# This template's marks, and marks of other common templates that texts shouldn't smuggle in.
BEGIN, END = "<|im_start|>", "<|im_end|>"
CONTROL = (BEGIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_RESTS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)

EXAMPLES = "conv_id long, example long, is_last boolean, text string, loss_start long, loss_end long"
# Bytes of texts in one output batch.
BATCH_BYTES = 4_000_000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def open_turn(role: str) -> str:
    return BEGIN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a formatted example."""
    turns = []
    for role, text in _TURN.findall(formatted):
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        turns.append((role, unescape(text)))
    return turns


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size_of) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def expand(conversations: DataFrame) -> DataFrame:
    """Examples (conv_id, example, is_last, text, loss_start, loss_end) of ``conversations(conv_id, turn, role, text)``.

    ``loss_start`` and ``loss_end`` are code points in ``text`` around the trainable reply; equal where there is none.
    Turns go by number (null first), equal numbers by role and text; null texts and roles are empty, rows with a null
    ``conv_id`` form one conversation, other columns are ignored, an empty table gives no example. A task holds one
    conversation's formatted text at a time, which is what its last example must hold anyway. The examples of a
    conversation come one after the other in a partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, number, prefix, length, pending, started = None, 0, [], 0, False, False
        for batch in batches:
            for conv_id, role, text, more in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "more")), strict=True):
                if not started or conv_id != conv:
                    conv, number, prefix, length, started = conv_id, 0, [], 0, True
                head, body = open_turn(role), escape(text)
                turn = head + body + END + "\n"
                prefix.append(turn)
                start = length + len(head)
                length += len(turn)
                reply = role == "assistant"
                if reply or not more:
                    whole = "".join(prefix)
                    prefix = [whole]
                    yield conv_id, number, not more, whole, start, start + len(body) * reply
                    number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "example", "is_last", "text", "loss_start", "loss_end"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
        yield from _batches(rows(batches), names, types, lambda r: len(r[3]))

    return _with_more(conversations).mapInArrow(run, EXAMPLES)


def _with_more(conversations: DataFrame) -> DataFrame:
    """Turns sorted by conversation, with ``more``: whether another turn of the conversation follows."""
    from pyspark.sql.window import Window

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.withColumn("more", F.lead(F.lit(True), 1, False).over(order))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples' texts: turns, trainable text and size.

    ``examples`` as ``expand`` gives them: those of a conversation one after the other in a partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        loss, loss_chars, chars = hashlib.sha256(), 0, 0
        for batch in batches:
            for conv_id, is_last, text, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "is_last", "text", "loss_start", "loss_end")), strict=True):
                trained = unescape(text[start:end])
                loss.update(trained.encode())
                loss_chars += len(trained)
                chars += len(text)
                if is_last:
                    turns, own = hashlib.sha256(), read_turns(text)
                    for role, said in own:
                        turns.update(f"{role}\n{said}\n".encode())
                    yield conv_id, len(own), turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield from _batches(rows(batches), names, types, lambda r: 200)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
