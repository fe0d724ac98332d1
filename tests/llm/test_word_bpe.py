import random
from hashlib import sha256

import pyarrow as pa
import pytest

from groundline.llm import word_bpe as W
from groundline.llm.queries import tokenizer_file

from .helpers import SF, awkward, has_data, nothing, rows

ODD = [
    "a", "b", "'", " ", "\n", "  ", "s", "ll", "1", "2", ",", ".", "é", "　", "\xa0", "re", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</s>", "\t", "日", "'re", "A",
    "́", "😀", "_", "²", "\x00", "\r\n", " the", "İ", "Σ", "ß", "ﬁ", "가", "ᄀ", "ᅡ", "K", "'S", "’", "v", "e", "l", "d", "m", "t", "'T", "aaaaaaa", "lllll", "</w>", "ͅ", "१",
]


@pytest.fixture(scope="module")
def coder():
    return W.WordBpe(tokenizer_file("word_bpe_49k.json").decode())


def odd_texts(n=6000):
    rng = random.Random(5)
    signs = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    letters = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 40))) for _ in range(n)]
    codes = ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(9)) for _ in range(n // 4)]
    return [*signs, *letters, *codes, None, "", "x" * 5000, "ab" * 3000 + "c"]


def test_ids_are_the_librarys(coder):
    texts = odd_texts() + ([r["text"] for r in rows("documents")] if has_data() else [])
    want = [e.ids for e in coder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    counts, ids = coder.encode(pa.array(texts))
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert 0 < coder.refuted < coder.proposed  # both ways were taken
    assert [coder.decode(w) for w in want] == [coder.library.decode(w, skip_special_tokens=False) for w in want]


def test_pairs_are_refuted_as_merging_them_would(coder):
    t, rng = coder.tables, random.Random(7)
    bodies = [i for i in range(len(t.names)) if t.sound[i] and not t.ends[i]]
    parts = {}

    def symbols(i):
        if i not in parts:
            parts[i] = [i] if t.rank[i] < 0 else symbols(int(t.left[i])) + symbols(int(t.right[i]))
        return parts[i]

    pairs = [(rng.choice(bodies[:3000]), rng.choice(bodies[:3000])) for _ in range(5000)]
    bad = t.crossed(*(W.np.array(x) for x in zip(*pairs)))
    for (a, b), crossed in zip(pairs, bad.tolist()):
        assert (t.merged(symbols(a) + symbols(b), coder.merges) != [a, b]) == crossed


def test_small_vocabulary_with_unsound_tokens():
    """Merging "abc" gives a, bc: the token abc can never come out, so it must not be proposed."""
    kind = {"model": {"end_of_word_suffix": "</w>", "vocab": {}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}}
    signs = W._byte_signs()
    for s in [*signs, *[s + "</w>" for s in signs], "bc", "ab", "abc"]:
        kind["model"]["vocab"][s] = len(kind["model"]["vocab"])
    t = W.MergeTables.read(kind)
    assert [bool(t.sound[kind["model"]["vocab"][s]]) for s in ("bc", "ab", "abc")] == [True, True, False]


def test_other_families_are_refused():
    with pytest.raises(ValueError):
        W.WordBpe(tokenizer_file("byte_bpe_50k.json").decode())


def hold(got, docs, library):
    want = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query(spark, coder):
    import __spark_entry__ as entry

    hold(entry.queries()["op11_bpe_round_trip"](spark, SF).collect(), [(r["doc_id"], r["text"]) for r in rows("documents")], coder.library)


def test_awkward_rows(spark, coder):
    definition, docs = tokenizer_file("word_bpe_49k.json").decode(), awkward(spark)
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    hold(W.round_trip_digest(docs, definition).collect(), given, coder.library)
    assert W.round_trip_digest(nothing(spark), definition).collect() == []
    encoded = W.encode(docs, definition)
    assert sorted(map(str, (r["ids"] for r in encoded.collect()))) == sorted(str(coder.library.encode(t or "", add_special_tokens=False).ids) for _, t in given)
    back = sorted(r["text"] for r in W.decode(encoded, definition).collect())
    assert back == sorted(coder.library.decode(coder.library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in given)
