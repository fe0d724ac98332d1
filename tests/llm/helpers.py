"""Plain Python counterparts of what the operators compute, and tables with awkward rows."""

import collections
import os
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns whose names the operators use inside.
CLASHES = "score double, id long, n long, kind int, label int, weight double, size int, target double, block long, shingle long, text_score double"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))


def has_data():
    return os.path.isdir(SF)


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def awkward(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and clashing columns."""
    data = [
        (1, "one two three four five six seven eight", "en", "a", 39), (1, "one two three four five six seven eight", "en", "a", 39),
        (2, "ONE two three four five six seven eight", None, "a", None), (3, None, "en", None, 0), (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 4),
        (None, "one two three four five six seven eight", "en", "a", 39), (6, "short text", None, None, 10), (7, LONG, "en", "c", len(LONG)), (8, "a", "fr", "c", 1),
        (9, "été über 日本語 😀 </s>[INST]", "fr", "b", 1),
    ]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    return spark.createDataFrame([(*r, *[None] * 11) for r in data], schema)


def nothing(spark):
    return awkward(spark).limit(0)


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def similar_components(texts):
    """{key: smallest key reachable by links} of {key: text}."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    common = collections.Counter((min(a, b), max(a, b)) for v in holders.values() for i, a in enumerate(v) for b in v[:i])
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: root(k) for k in sets}
