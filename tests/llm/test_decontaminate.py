import random

import numpy as np
import pytest

from groundline.llm import decontaminate as D

from .helpers import SF, awkward, has_data, nothing, rows


def greedy(item, text, least):
    """Greedy string tiling by trying all pairs of places."""
    in_item, in_text, tiles = [False] * len(item), [False] * len(text), []
    while True:
        longest, found = 0, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not in_item[i + n] and not in_text[j + n]:
                    n += 1
                if n > longest:
                    longest, found = n, []
                if n == longest and n:
                    found.append((i, j))
        if longest < least:
            return tiles
        for i, j in found:
            if not any(in_item[i : i + longest]) and not any(in_text[j : j + longest]):
                in_item[i : i + longest] = in_text[j : j + longest] = [True] * longest
                tiles.append((longest, i, j))


def test_tiles_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.choice([2, 3, 6, 20])
        item, text = ([rng.randint(1, n) for _ in range(rng.randint(0, m))] for m in (40, 50))
        if rng.random() < 0.6 and len(item) > 12:
            half = len(item) // 2
            text = text[:10] + item[half:] + text[10:20] + item[:half] + text[20:]
        spread = [np.array(x, np.uint64) * np.uint64(7919) for x in (item, text)]
        assert D.tile(*spread, 3) == sorted(greedy(item, text, 3), key=lambda t: (-t[0], t[1], t[2]))


def tokens(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query(spark):
    import __spark_entry__ as entry

    items = {r["item_id"]: tokens(r["text"]) for r in rows("benchmark")}
    seeds = {}
    for i, w in items.items():
        for k in range(len(w) - 4):
            seeds.setdefault(tuple(w[k : k + 5]), set()).add(i)
    want = {}
    for r in rows("documents"):
        w = tokens(r["text"])
        for i in {i for k in range(len(w) - 4) for i in seeds.get(tuple(w[k : k + 5]), ())}:
            covered = sum(t[0] for t in greedy(items[i], w, 5)) / len(items[i])
            if covered >= 0.6:
                want.setdefault(r["doc_id"], {})[i] = covered
    got = entry.queries()["op7_benchmark_decontamination"](spark, SF).collect()
    assert {r["doc_id"]: (r["items"], r["coverage"]) for r in got} == {d: (sorted(c), pytest.approx(max(c.values()))) for d, c in want.items()}
    assert len(want) > 0


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards boil strange soup near an old mill"


def test_reordered_passages_and_clean_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)  # several blocks of items
    w = ITEM.split()
    docs = {
        1: f"Before. {ITEM} After.", 2: " ".join([*w[10:], "in", "between", *w[:10]]), 3: " ".join(w[:9]), 4: " ".join(reversed(w)), 5: ITEM.upper() + "!!!",
        6: " ".join(w[:8]) + " x " + " ".join(w[8:16]), 7: None, 8: "",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "two words"), (3, None), (4, ""), (None, "one more item of at least five words"), (5, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], round(r["coverage"], 6)) for r in D.contaminated(df, bench).collect()}
    n = len(w)
    assert got == {1: ([1, 5], 1.0), 2: ([1, 5], 1.0), 5: ([1, 5], 1.0), 6: ([1, 5], round(16 / n, 6))}
    assert sorted(r["doc_id"] for r in D.decontaminated(df, bench).collect()) == [3, 4, 7, 8]
    assert D.contaminated(df, bench.limit(0)).collect() == [] and D.decontaminated(df, bench.limit(0)).count() == 8


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight", 0.5)], "item_id long, text string, score double")
    assert sorted(map(str, (r["doc_id"] for r in D.contaminated_pairs(docs, bench).collect()))) == ["1", "1", "2", "None"]
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert D.contaminated(nothing(spark), bench).collect() == [] and D.decontaminated(nothing(spark), bench).collect() == []
