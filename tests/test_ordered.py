import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docpipe.operators.ordered import Ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; the ordering column has ties and a burst."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        t = 500 if rng.random() < 0.2 else rng.randrange(1000)
        data.append((key, t, i, rng.choice([None, *range(5)])))
    return spark.createDataFrame(data, "k string, t bigint, i bigint, v int").cache()


def plain(df, expr):
    return df.withColumn("x", expr)


@pytest.mark.parametrize("segments", [1, 5, 60, None])
def test_previous_equals_lag(skewed, rows, segments):
    got = Ordered(skewed, ["k"], ["t", "i"], segments).previous(["v", "t"])
    w = Window.partitionBy("k").orderBy("t", "i")
    want = skewed.select("*", F.lag("v").over(w).alias("prev_v"), F.lag("t").over(w).alias("prev_t"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("segments", [1, 5, 60, None])
def test_row_number(skewed, rows, segments):
    got = Ordered(skewed, ["k"], ["t", "i"], segments).row_number("x")
    want = plain(skewed, F.row_number().over(Window.partitionBy("k").orderBy("t", "i")).cast("bigint"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("segments", [1, 30])
def test_string_order(skewed, rows, segments):
    """Any sortable order column, with nulls, ties and a hot key."""
    text = skewed.withColumn("t", F.when(F.col("t") % 7 > 0, F.concat(F.lit("x"), F.col("t").cast("string"))))
    got = Ordered(text, ["k"], ["t", "i"], segments).previous(["v"])
    w = Window.partitionBy("k").orderBy("t", "i")
    assert rows(got) == rows(text.select("*", F.lag("v").over(w).alias("prev_v")))


def test_a_hot_key_is_cut(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), "id")
    sizes = [r["count"] for r in Ordered(df, ["k"], ["id"], 10).cut.groupBy("_seg").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2000
