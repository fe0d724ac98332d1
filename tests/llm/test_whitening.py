import math

import numpy as np
import pytest

from groundline.llm.whitening import whitened_rows

from .helpers import SF, has_data, rows

SCHEMA = "vec_id long, embedding array<float>, x long, n long, cell double"


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def hold(got, data, most=16):
    """Rows against numpy's eigenvectors of the covariance of the distinct grid vectors."""
    kept = [(i, v) for i, v in data if usable(v)]
    grid = {tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in kept}
    n, fit = len(grid), np.array(sorted(grid))
    total = [sum(c) for c in zip(*grid)]
    centred = (fit * n - np.array(total)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(kept)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append(r)
    signs = None
    for i, v in kept:
        x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
        deviation = [n * a - b for a, b in zip(x, total)]
        own = [next(r for r in found[i] if r["component"] == c) for c in range(1, k + 1)]
        assert all(r["n"] == n and r["deviation"] == sum(q * q for q in deviation) for r in own)
        want = (np.array(deviation, float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        have = np.array([r["whitened"] for r in own])
        if signs is None and (np.abs(want) > 1e-3).all():
            signs = np.sign(want * have)
        np.testing.assert_allclose(np.abs(have), np.abs(want), atol=1e-6)
        if signs is not None:
            np.testing.assert_allclose(have, want * signs, atol=1e-6)
        np.testing.assert_allclose([r["explained"] for r in own], values[:k] / values.sum(), rtol=1e-6)
        assert all(0 <= r["identity_error"] < 1e-8 for r in own)


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query(spark):
    import __spark_entry__ as entry

    hold(entry.queries()["op13_embedding_whitening"](spark, SF).collect(), [(r["vec_id"], r["embedding"]) for r in rows("embeddings")])


def frame(spark, data):
    return spark.createDataFrame([(i, v, None, None, None) for i, v in data], SCHEMA)


def test_ill_conditioned(spark):
    """Variances over nine orders of magnitude: the shift is far above the smallest one."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 6)) * 10.0 ** np.array([3, 2, 1, 0, -1, -1.5])
    data = [(i, v) for i, v in enumerate(base.tolist())]
    hold(whitened_rows(frame(spark, data)).collect(), data)


def test_dependent_columns_and_repeats(spark):
    rng = np.random.default_rng(2)
    base = np.round(rng.normal(size=(60, 3)) * 20)
    wide = np.hstack([base, base[:, :1], base[:, :1] + base[:, 1:2], np.full((60, 1), 7.0)])
    data = [(i, v) for i, v in enumerate(wide.tolist())] + [(1000 + i, wide[0].tolist()) for i in range(100)]
    hold(whitened_rows(frame(spark, data)).collect(), data)


def test_few_rows_and_odd_ones(spark):
    data = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.5, -1.0]), (None, [0.5, 0.25, 9.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [])]
    hold(whitened_rows(frame(spark, data)).collect(), data)
    hold(whitened_rows(frame(spark, data), most=1).collect(), data, most=1)


def test_no_variance(spark):
    assert whitened_rows(frame(spark, [])).collect() == []
    assert whitened_rows(frame(spark, [(1, None)])).collect() == []
    assert whitened_rows(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_lengths_and_large_entries(spark):
    data = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [1e30, 1.0]), (5, [2.0, 2.0])]
    got = whitened_rows(frame(spark, data)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 5}
    large = [(i, [float(2**40 + i * 2**30), float(i % 3)]) for i in range(9)]
    got = whitened_rows(frame(spark, large)).collect()
    assert len(got) == 18 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)
    assert all(r["identity_error"] < 1e-6 for r in got)
