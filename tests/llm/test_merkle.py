import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from groundline.llm.merkle import fifth, manifest

from .helpers import SF, awkward, has_data, lower, nothing, rows


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def expected(docs):
    sources = {}
    for r in docs:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    (root,) = top[-1]
    out = []
    for at, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, at)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf(r, r["text"] and lower(r["text"])) if hit else own
            for before, after in steps:
                node = H("".join([*before, node, *after]))
            proof = H("".join("".join(b + a) for b, a in steps))
            out.append((r["doc_id"], own, trees[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in manifest(df, fifth(F.col("doc_id")), **options).collect()), key=str)


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query(spark):
    import __spark_entry__ as entry

    found = sorted((tuple(r) for r in entry.queries()["op12_merkle_manifest"](spark, SF).collect()), key=str)
    assert found == expected(rows("documents"))
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [17, 1, 256], [1] * 40 + [4097]])
def test_superblocks_of_two_levels_and_one(spark, sizes):
    """Trees that end in one superblock, in several, and in several turns of superblocks; more sources than one run holds."""
    data = [(k * 10_000 + i, None if k == 3 else f"s{k}", "en", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    want = expected([r.asDict() for r in df.collect()])
    for depth in (1, 2) if sum(sizes) < 1000 else (2,):
        assert got(df, depth=depth) == want


def test_awkward_rows(spark):
    df = awkward(spark)
    assert got(df) == expected([r.asDict() for r in df.collect()])
    assert got(nothing(spark)) == []
    assert all(r["verified"] for r in manifest(df).collect())
