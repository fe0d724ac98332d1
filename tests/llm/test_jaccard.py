import random
from fractions import Fraction

import numpy as np
import pytest

from groundline.llm import components as C
from groundline.llm import jaccard as J
from groundline.llm.components import components

from .helpers import SF, awkward, has_data, nothing, rows, shingles, similar_components


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query(spark):
    import __spark_entry__ as entry

    texts = {r["doc_id"]: r["text"] for r in rows("documents")}
    want = similar_components(texts)
    got = entry.queries()["op3_ngram_jaccard_join"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, len(shingles(t)), want[k]) for k, t in texts.items())


def near_copies(seed, n):
    """Chains and stars of copies whose similarity lies around the threshold, of many sizes, with a shared passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 40, 120, 300]))]
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_around_the_threshold(spark, monkeypatch, small):
    if small:  # many windows, split blocks, frequent shingles
        for name, value in (("WINDOW", 800), ("BLOCK", 3), ("FREQUENT", 2), ("TOLD_APART", 300), ("PAIRS_FOR_EACH", 0)):
            monkeypatch.setattr(J, name, value)
    texts = dict(enumerate(near_copies(int(small), 120)))
    got = J.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == similar_components(texts)


def test_awkward_rows(spark):
    got = sorted((tuple(r) for r in J.similar_components(awkward(spark)).collect()), key=str)
    eight = 4
    want = [(1, eight, 1), (1, eight, 1), (2, eight, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, eight, 1), (6, 1, 6), (7, 59_996, 7), (8, 1, 8), (9, 1, 9)]
    assert got == sorted(want, key=str)
    assert J.similar_components(nothing(spark)).collect() == []


def test_one_of_each(spark):
    docs = awkward(spark)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 3, 4, 5, None, 6, 7, 8, 9]))
    assert J.one_of_each(nothing(spark)).collect() == []


def test_tree_keeps_every_similar_pair():
    rng = random.Random(4)
    for turn in range(30):
        texts = near_copies(turn, rng.randint(2, 60))
        sets = sorted((np.unique(np.array([hash(x) & 0xFFFFFFFFFFFFFFFF for x in shingles(t)], np.uint64)) for t in texts), key=len)
        sizes = np.array([len(s) for s in sets])
        i, j = J.candidate_pairs([J.bitmap(s) for s in sets], sizes, np.arange(len(sets)))
        found = set(zip(i.tolist(), j.tolist(), strict=True))
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 4 * n >= 3 * (len(sets[a]) + len(sets[b]) - n):
                    assert (a, b) in found


def test_tree_prunes_unlike_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(64)]
    i, _ = J.candidate_pairs([J.bitmap(s) for s in sets], np.array([len(s) for s in sets]), np.arange(64))
    assert len(i) == 0


def test_other_similarity(spark):
    texts = {1: "a b c d e f g h i j", 2: "a b c d e f g h x y", 3: "q r s t u v"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = lambda t: [r["component_id"] for r in sorted(J.similar_components(df, t).collect())]
    assert ids(Fraction(1, 2)) == [1, 1, 3] and ids(Fraction(3, 4)) == [1, 2, 3]


def template_pages(seed, n):
    """Pages that share most shingles of one template but are no copies, and a copy of every tenth."""
    rng = random.Random(seed)
    template = " ".join(f"t{i}" for i in range(96))
    texts = []
    for page in range(n):
        texts.append(template + " " + " ".join(f"p{page}x{rng.randint(0, 9999)}" for _ in range(22)))
        if page % 10 == 0:
            texts.append(texts[-1] + " end")
    return texts


def test_unlinked_pages_of_one_template_stay_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 10)
    largest = {}

    def watched(name):
        plain = getattr(J, name)

        def run(members, *rest):
            most = members.groupBy("block").count().agg({"count": "max"}).first()[0] or 0
            largest[name] = max(largest.get(name, 0), most)
            return plain(members, *rest)

        monkeypatch.setattr(J, name, run)

    watched("_traversed")
    watched("_links")
    texts = dict(enumerate(template_pages(3, 200)))
    got = J.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == similar_components(texts)
    assert largest["_traversed"] <= 50 and largest["_links"] <= 50  # two parts of a block at most, dealt by a hash


@pytest.mark.parametrize("own", [22, 30])
def test_rows_of_the_last_blocks_grow_with_the_pages_of_a_template(spark, monkeypatch, own):
    monkeypatch.setattr(J, "BLOCK", 10)
    found = {}

    def watched(rows_open, sizes, ratio):
        blocks = plain(rows_open, sizes, ratio)
        found[now] = (rows_open.count(), blocks.count())
        return blocks

    plain = J._last_blocks
    monkeypatch.setattr(J, "_last_blocks", watched)
    for now in (100, 400):
        rng = random.Random(now)
        template = " ".join(f"t{i}" for i in range(96))
        texts = {p: template + " " + " ".join(f"p{p}x{rng.randint(0, 9999)}" for _ in range(own)) for p in range(now)}
        got = J.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {p: p for p in texts}
    assert all(blocks <= 4 * rows for rows, blocks in found.values())


def test_last_blocks_hold_every_pair_once_led(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(6)
    size = {i: rng.choice([60, 70, 80, 81, 95, 140, 300]) for i in range(240)}
    label = {i: 0 if rng.random() < 0.5 else i for i in size}
    lead = {i: rng.random() < 0.3 for i in size}
    rows = [(7, i, label[i], lead[i], len(size)) for i in size] + [(8, i, label[i], True, 5) for i in range(5)]
    opened = spark.createDataFrame(rows, "shingle long, id long, label long, lead boolean, count long")
    blocks = {}
    for r in J._last_blocks(opened, spark.createDataFrame(list(size.items()), "id long, n long"), 4 / 3).collect():
        blocks.setdefault(r["block"], []).append((r["id"], r["lead"]))
    met = {(a, b) for members in blocks.values() for a, led in members if led for b, _ in members}
    near = lambda a, b: 4 * size[a] >= 3 * size[b] and size[a] <= size[b]
    wanted = {(a, b) for a in size for b in size if lead[a] and label[a] != label[b] and near(a, b)}
    assert wanted and wanted <= met
    assert max(map(len, blocks.values())) <= 60  # a part of each side


def test_stars_are_dealt_and_compared_with_their_center(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 10)
    pairs = spark.createDataFrame([(1, b) for b in range(2, 202)] + [(500, 501)], "a long, b long")
    blocks = {}
    for r in J._stars(pairs).collect():
        blocks.setdefault(r["block"], []).append((r["id"], r["center"]))
    assert all(sum(c for _, c in rows) == 1 and len(rows) <= 31 for rows in blocks.values())
    found = [(next(i for i, c in rows if c), i) for rows in blocks.values() for i, c in rows if not c]
    assert sorted(found) == sorted(tuple(r) for r in pairs.collect())
    base = np.arange(100, dtype=np.uint64)
    sets = [base[:80], base[:90], base[20:]]  # the first and the last are alike to the middle one only
    assert sorted(map(sorted, J.block_links([7, 8, 9], sets, [7, 8, 9], center=8))) == [[7, 8]]
    assert J.block_links([7, 8, 9], sets, [7, 8, 9], center=9) == []


@pytest.mark.parametrize("chunk", [200_000, 40])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK_LINKS", chunk)
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in list(parent)} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
