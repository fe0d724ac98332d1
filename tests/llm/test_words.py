import random

import numpy as np
import pyarrow as pa

from groundline.llm import segments as S

from .helpers import words


def test_words_are_cut_as_the_pattern_says():
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\tabAB é\x1f.") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    hashes, rows = S.words(pa.array(texts))
    names = {}
    for text, a, b in zip(texts, rows[:-1], rows[1:], strict=True):
        own = words(text)
        assert len(own) == b - a
        for word, h in zip(own, hashes[a:b].tolist(), strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_passes_keep_rows_whole_and_in_order():
    texts = ["x" * n for n in (0, 5, 1, 9, 3, 3, 20, 0)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(S.passes(iter([batch]), most=8))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(sum(map(len, p.column("text").to_pylist())) <= 8 or p.num_rows == 1 for p in parts)


def test_shingle_sets():
    hashes, rows = S.words(pa.array(["a b c d e f", "a b", "", None, "a b c d e a b c d e a b c d e"]))
    sets = S.shingle_sets(hashes, rows)
    assert [len(s) for s in sets] == [2, 1, 0, 0, 5]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets if len(s) > 1)


def test_ragged():
    assert S.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert S.ragged(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
