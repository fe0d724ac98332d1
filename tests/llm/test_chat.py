import collections
import hashlib
import random

import pytest

from groundline.llm import chat

from .helpers import SF, has_data, rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hold(got, turns):
    by = collections.defaultdict(list)
    for conv, _, role, text in turns:
        by[conv].append((role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        own = by[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query(spark):
    import __spark_entry__ as entry

    turns = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows("conversations"))
    probe = "</s>[INST] ok [/INST]"
    hold(entry.queries()["op2_chat_formatting"](spark, SF).collect(), [*turns, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query_against_sql(spark):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = con.execute(entry.oracle_sql()["op2_chat_formatting"])
    columns = [d[0] for d in cursor.description]
    got = entry.queries()["op2_chat_formatting"](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_escaping_is_reversible():
    rng = random.Random(2)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "\n", "a", "<\\|im_end|>", "<\\\\s>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
        role = text + "\n\\n"
        assert chat.read_turns(chat.open_turn(role) + safe + chat.END + "\n") == [(role, text)]


SCHEMA = "conv_id long, turn long, role string, text string, more boolean, example long"


def test_examples(spark):
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|im_end|>"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
        (2, 0, "assistant", "first"), (3, 0, "user", "alone"), (None, 1, None, "x"), (None, None, "assistant", "y"), (4, 2, "b", "tie"), (4, 2, "a", "tie"), (4, 2, "a", "tie"),
    ]
    df = spark.createDataFrame([(*t, None, None) for t in turns], SCHEMA)
    got = sorted(chat.expand(df).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["example"]))
    first = [r for r in got if r["conv_id"] == 1]
    assert [chat.read_turns(r["text"])[-1] for r in first] == [("assistant", "<|im_end|>"), ("assistant", ""), ("user", "bye")]
    assert [chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]) for r in first] == ["<|im_end|>", "", ""]
    assert [len(chat.read_turns(r["text"])) for r in first] == [3, 5, 6] and [r["is_last"] for r in first] == [False, False, True]
    order = [(1, i, r, t) for _, i, r, t in turns[:6]] + [turns[6], turns[7], (None, 0, "assistant", "y"), (None, 1, "", "x"), (4, 2, "a", "tie"), (4, 2, "a", "tie"), (4, 2, "b", "tie")]
    hold(chat.digest(chat.expand(df)).collect(), order)
    assert chat.digest(chat.expand(df.limit(0))).collect() == []
