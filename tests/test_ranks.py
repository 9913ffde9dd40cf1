import random

import pytest
from pyspark.sql import functions as F

from labelpick.operators.ranks import positions, positions_within
from labelpick.operators.sets import label_codes


def table(spark, n=400):
    rng = random.Random(1)
    # two thirds of all rows are of one group, half of those are equal in every column
    rows = [(rng.choice([None, "b", "c"]) if i % 3 == 0 else "a", 7 if i % 2 else rng.randint(0, 20), i % 5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x int, y int").repartition(7)


def test_places_follow_the_order_and_are_whole(spark):
    rows, df = table(spark)
    got = positions(df, F.desc("x"), "y").orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert [(r.x, r.y) for r in got] == sorted(((x, y) for _, x, y in rows), key=lambda r: (-r[0], r[1]))


def test_places_within_groups(spark):
    rows, df = table(spark)
    got = positions_within(df, "g", "x", "y").collect()
    for group in (None, "a", "b", "c"):
        mine = sorted(((r.position, r.x, r.y, r.total) for r in got if r.g == group))
        want = sorted((x, y) for g, x, y in rows if g == group)
        assert [(x, y) for _, x, y, _ in mine] == want
        assert [p for p, *_ in mine] == list(range(len(want))) and {t for *_, t in mine} == {len(want)}


def test_equal_rows_spread_over_ranges(spark):
    stored = []

    def keep(df, name):
        from labelpick.session import materialize
        stored.append(materialize(df, name))
        return stored[-1]

    same = spark.range(3000, numPartitions=6).select(F.lit(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positions(same, "x", write=keep)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.countDistinct("position")).first()[0] == 3000
    sizes = [r["count"] for r in stored[0].groupBy("_part").count().collect()]
    assert len(sizes) == 3 and max(sizes) < 2000


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, x int")
    assert positions(df, "x").columns == ["g", "x", "position"] and positions(df, "x").count() == 0
    assert positions_within(df, "g", "x").count() == 0


@pytest.mark.parametrize("labels", [[3, None, 1, 1, 9], []])
def test_label_codes_have_no_unpartitioned_window(spark, labels):
    df = spark.createDataFrame([(x,) for x in labels], "label int")
    codes = label_codes(df)
    assert "Window" not in codes._jdf.queryExecution().executedPlan().toString()
    known = sorted({x for x in labels if x is not None})
    assert sorted(map(tuple, codes.collect())) == list(zip(known, range(len(known))))
