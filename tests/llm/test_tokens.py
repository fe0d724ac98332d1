import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from groundline.llm import token_counts as C
from groundline.llm import token_files as T
from groundline.llm.chunks import ChunkMemory
from groundline.llm.queries import tokenizer_file

from .helpers import SF, awkward, has_data, nothing, rows

ODD = ["a", "b", "'", " ", "\n", "  ", "s", "ll", "1", "2", ",", ".", "é", "　", "\xa0", " ", "<|endoftext|>", "</s>", "\t", "日", "'re", "A", "́", "😀", "_", "²", "\x00", "\r\n", "▁", " the", "    "]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [None, ""]


def test_ids_are_the_librarys():
    own = T.ByteLevelTokenizer(tokenizer_file("byte_bpe_50k.json").decode())
    texts = odd_texts(3000) + [r["text"] for r in rows("documents")[:40]] if has_data() else odd_texts(3000)
    counts, ids = own.encode(pa.array(texts))
    want = [e.ids for e in own.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_tokenizers_go_to_the_library_whole():
    own = T.ByteLevelTokenizer(tokenizer_file("word_bpe_49k.json").decode())
    counts, ids = own.encode(pa.array(["Hello there", None, ""]))
    want = own.library.encode("Hello there", add_special_tokens=False).ids
    assert not own.by_chunk and counts.tolist() == [len(want), 0, 0] and ids.tolist() == want


def test_counts_are_the_librarys():
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = odd_texts(3000) + ([r["text"] for r in rows("documents")[:40]] if has_data() else [])
    got = C.MergeRanks(model).counts(pa.array(texts))
    assert got.tolist() == [len(library.encode(t or "")) for t in texts]


def test_chunk_memory_forgets():
    seen = []

    def measure(chunks):
        seen.extend(chunks)
        return np.array([len(c) for c in chunks]), np.concatenate([np.frombuffer(c, np.uint8) for c in chunks])

    memory = ChunkMemory(measure, limit=2)
    for word in (b"ab", b"c", b"ab", b"d", b"ab"):
        data = np.frombuffer(word, np.uint8)
        places = memory.places(data, np.array([0]), np.array([len(word)]))
        assert bytes(memory.stream(places).astype(np.uint8)) == word
    assert seen == [b"ab", b"c", b"d", b"ab"]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
@pytest.mark.parametrize("most", [1, 2, 50_258, 70_000])
def test_wavelet_matrix(size, most):
    ids = np.random.default_rng(size).integers(0, most, size)
    doc_ids, counts, matrix = T.from_file(T.to_file([None, 5], np.array([size, 0]), ids))
    assert doc_ids == [None, 5] and counts.tolist() == [size, 0]
    assert (matrix.decode() == ids).all() and (matrix.access(np.arange(size)) == ids).all()
    for token in {*ids[:20].tolist(), 0, most, 1 << 20}:
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places) and matrix.locate(token).tolist() == places.tolist()
        assert matrix.count(token, size // 3, size // 2) == (ids[size // 3 : size // 2] == token).sum()


def hold_files(got, docs):
    library = T.ByteLevelTokenizer(tokenizer_file("byte_bpe_50k.json").decode()).library
    start, want = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_token_files_query(spark, monkeypatch):
    import __spark_entry__ as entry

    hold_files(entry.queries()["op8_token_files"](spark, SF).collect(), [(r["doc_id"], r["text"]) for r in rows("documents")])


def test_token_files_of_awkward_rows(spark):
    docs = awkward(spark)
    definition = tokenizer_file("byte_bpe_50k.json").decode()
    hold_files(T.token_files(docs, definition).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert T.token_files(nothing(spark), definition).collect() == []


def test_many_shards(spark, tmp_path):
    docs = [(i, f"text number {i} " * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    manifest = T.write_token_files(df, tokenizer_file("byte_bpe_50k.json").decode(), str(tmp_path), shard_tokens=40).collect()
    assert sum(m["n_docs"] for m in manifest) == 60 and len(list(tmp_path.glob("*.wm"))) == len(manifest)
    hold_files(T.token_digest(spark, str(tmp_path)).collect(), docs)


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_token_counts_query(spark):
    import sentencepiece

    import __spark_entry__ as entry

    library = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_file("piece_bpe_32k.model"))
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 4096) for r in rows("documents")]
    assert sorted(map(tuple, entry.queries()["op9_token_counts"](spark, SF).collect())) == sorted(want)


def test_token_counts_of_awkward_rows(spark):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = awkward(spark)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in C.count_tokens(docs, model).collect()), key=str)
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 4096) for r in docs.collect()]
    assert got == sorted(want, key=str)
    assert C.count_tokens(nothing(spark), model).collect() == []
