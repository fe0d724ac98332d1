import collections
import math
import zlib

import numpy as np
import pytest

from groundline.llm import lm

from .helpers import SF, awkward, has_data, nothing, rows, words


def expected(docs):
    """(held out, tokens, known, training tokens, base, score) of every (doc_id, text), by plain counting."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*words(t), "\0end"] for _, t in docs]
    count, pairs = collections.Counter(), collections.Counter()
    for (i, _), w in zip(docs, tokens, strict=True):
        if not held(i):
            count.update(w)
            pairs.update(zip(["\0begin", *w[:-1]], w, strict=True))
    count["\0begin"] = 0
    total, different = sum(count.values()), sum(c > 0 for c in count.values())
    context = collections.Counter(a for (a, _), n in pairs.items() for _ in range(n))
    single = lambda w: (count[w] + 1) / (total + different + 1)
    out = []
    for (i, _), w in zip(docs, tokens, strict=True):
        score = 0.0
        for a, b in zip(["\0begin", *w[:-1]], w, strict=True):
            spread = lm.A + lm.B * math.sqrt(context[a])
            score += math.log10((pairs[a, b] + spread * single(b)) / (context[a] + spread))
        out.append((i, held(i), len(w), sum(count[x] > 0 for x in w), total, sum(math.log10(single(x)) for x in w), score))
    return out


def hold(got, docs):
    want = sorted(expected(docs), key=str)
    got = sorted((tuple(r) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.skipif(not has_data(), reason="no test tables")
@pytest.mark.parametrize("block", [lm.BLOCK_TOKENS, 3000])
def test_query(spark, monkeypatch, block):
    import __spark_entry__ as entry

    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    got = entry.queries()["op4_lm_scoring"](spark, SF).collect()
    hold(got, [(r["doc_id"], r["text"]) for r in rows("documents")])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_awkward_rows(spark):
    docs = awkward(spark)
    hold(lm.score_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert lm.score_documents(nothing(spark)).collect() == []


def test_probabilities_of_a_state_add_up_to_one():
    counts = np.array([2, 2, 0, 1])
    pairs, pair_counts = np.array([1 * 4 + 0, 2 * 4 + 1, 2 * 4 + 3]), np.array([2, 1, 1])
    model = lm.BackoffAutomaton(counts, 2, pairs, pair_counts, 5, 3)
    log = lambda *tokens: model.traverse(np.array(tokens), np.array([len(tokens)]))[0]
    # words 0, 1 and 3 are known, 2 stands for all unknown ones
    assert sum(10 ** (log(0, w) - log(0)) for w in range(4)) == pytest.approx(1.0)
    assert sum(10 ** log(w) for w in range(4)) == pytest.approx(1.0)  # from the begin of a text
    assert 10 ** (log(2, 2) - log(2)) == pytest.approx(1 / 9)  # from the root


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**56, 1000).astype(np.uint64))
    assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all() and len(lm.pack_sorted(keys)) < 8 * len(keys)
    counts = np.array([0, 1, 5, 1 << 40])
    assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()
    assert lm.parted(lm.joined([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]
    empty = np.zeros(0, np.uint64)
    assert len(lm.unpack_sorted(lm.pack_sorted(empty))) == 0 and len(lm.unpack_counts(lm.pack_counts(empty))) == 0
