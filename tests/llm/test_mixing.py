import collections

import pytest
from pyspark.sql import functions as F

from groundline.llm.mixing import due, mix, training_order

from .helpers import SF, WORD, awkward, has_data, nothing, rows


def targets(sizes, share=1.5, most=2.0):
    """Water filling by repetition; a null source is last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, goal, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(goal.values())
        each = rest / sum(weight[n] for n in free)
        full = [n for n in free if each * weight[n] > most * sizes[n]]
        if not full:
            goal |= {n: each * weight[n] for n in free}
            break
        goal |= {n: most * sizes[n] for n in full}
        free -= set(full)
    return goal


def hold(got, docs):
    sizes = collections.Counter()
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    goal, taken = targets(sizes), collections.Counter()
    source = {(d["doc_id"], len(WORD.findall(d["text"] or ""))): d["source"] for d in docs}
    assert len(got) == len(docs)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["first_words"] + r["second_words"]
        assert (r["position"] is None) == (r["first_words"] == 0) and (r["second_position"] is None) == (r["second_words"] == 0)
        assert all(0 <= p <= 1 for p in (r["position"], r["second_position"]) if p is not None)
    assert all(abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in goal)


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_query_against_water_filling(spark):
    import __spark_entry__ as entry

    query = entry.queries()["op1_mixing"]
    got = query(spark, SF).collect()
    hold(got, rows("documents"))
    assert sorted(map(str, query(spark, SF).collect())) == sorted(map(str, got))


def test_awkward_rows(spark):
    docs = awkward(spark)
    hold(mix(docs).collect(), [r.asDict() for r in docs.collect()])
    assert mix(nothing(spark)).collect() == []


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mix(docs).collect()] == [(0, 0.0)] * 2


def test_due_inverts_the_demand(spark):
    steps = F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0))
    df = spark.createDataFrame([(float(w),) for w in (0, 10, 20, 25, 50, 80)], "w double")
    got = [r[0] for r in df.select(due(F.col("w"), F.lit(80.0), steps)).collect()]
    assert got == pytest.approx([0, 1 / 6, 2 / 3, 2 / 3 + 5 / 180, 2 / 3 + 30 / 180, 1])


def test_training_order(spark):
    docs = awkward(spark)
    out = training_order(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = collections.Counter()
    text = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["text"] for r in docs.collect()}
    for r in mix(docs).collect():
        for n in (r["first_words"], r["second_words"]):
            if n and 2 * n >= r["size"]:
                want[r["doc_id"], text[r["doc_id"], r["size"]]] += 1
    assert got == want
    assert training_order(nothing(spark)).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = mix(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_the_mix_is_in_training_order(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 9)) for i in range(300)], "doc_id long, source string, text string")
    at = [r["position"] if r["position"] is not None else r["second_position"] for r in mix(docs).collect()]
    taken = [a for a in at if a is not None]
    assert taken == sorted(taken) and at[: len(taken)] == taken and 0 < len(taken) < 300
