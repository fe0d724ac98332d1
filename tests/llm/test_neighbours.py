import numpy as np
import pyarrow.parquet as pq
import pytest

from groundline.llm import neighbours as N

from .helpers import SF, has_data


def brute(ids, vectors, query, vector, k):
    distance = np.sqrt(((vectors - vector) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, distance)) if ids[i] != query][:k]
    return [(r + 1, int(ids[i]), distance[i]) for r, i in enumerate(order)]


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query(spark):
    import __spark_entry__ as entry

    table = pq.read_table(f"{SF}/embeddings.parquet")
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_pylist()).astype(float)
    got = entry.queries()["op5_nearest_neighbours"](spark, SF).collect()
    for q in ids[ids % 100 == 0].tolist():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = brute(ids, vectors, q, vectors[ids == q][0], 10)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert [m[2] for m in mine] == pytest.approx([w[2] for w in want], rel=1e-13)
    assert len(got) == 10 * (ids % 100 == 0).sum()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim int, rank int")


def test_many_trees_and_relaxed_pruning(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(900, 8)) + 4 * rng.integers(0, 3, size=(900, 1))).astype(np.float32)
    ids = np.arange(900)
    df = frame(spark, [(int(i), v.tolist(), 0, 0, 0) for i, v in zip(ids, vectors, strict=True)]).repartition(3)
    queries = df.where("vec_id % 50 = 0")
    want = {q: {w[1] for w in brute(ids, vectors.astype(float), q, vectors[q].astype(float), 5)} for q in range(0, 900, 50)}
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        got = N.nearest(df, queries, k=5, factor=factor, shard_vectors=200).collect()
        recall = np.mean([len({r["vec_id"] for r in got if r["query_id"] == q} & w) / 5 for q, w in want.items()])
        assert recall >= least, factor


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BYTES", 60)  # several passes
    nan, inf = float("nan"), float("inf")
    df = frame(spark, [
        (0, [1.0, 0.0], 0, 0, 0), (1, [1.0, 0.0], 0, 0, 0), (2, [1.0, 0.0], 0, 0, 0), (3, None, 0, 0, 0), (4, [0.0, 0.0], 0, 0, 0), (5, [nan, 1.0], 0, 0, 0),
        (6, [inf, 1.0], 0, 0, 0), (7, [None, 1.0], 0, 0, 0), (8, [], 0, 0, 0), (None, [1.0, 1.0], 0, 0, 0), (9, [1.0, 2.0, 3.0], None, None, None), (10, [0.0, 1.0], 0, 0, 0),
    ])
    got = sorted(tuple(r) for r in N.nearest(df, df, k=2).collect())
    root = pytest.approx(2**0.5)
    assert got == [
        (0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 1, 0, 0.0), (1, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0), (10, 1, 0, root), (10, 2, 1, root),
    ]
    assert N.nearest(df.limit(0), df.limit(0)).collect() == []
    assert N.nearest(df.limit(0), df, k=3).collect() == []
