from groundline.functions import numeric as N
from groundline.session import spread


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(0, 5000, numPartitions=2)
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spread(rows, 500)
    assert wide.rdd.getNumPartitions() == 10 and wide.count() == 5000


def test_a_text_is_read_once_for_its_amounts(spark):
    df = spark.createDataFrame([("US$ 1,250 mil millones y S/. 3 millones, $7",)], "t string")
    found = df.select(N.money_phrases(df.t).alias("m"))
    assert [tuple(m) for m in found.first()["m"]] == [
        ("usd", "1250", "1250000000000", "US$ 1,250 mil millones"), ("pen", "3", "3000000", "S/. 3 millones"), ("usd", "7", "7", "$7")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
