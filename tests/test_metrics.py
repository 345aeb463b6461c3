import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.operators import metrics as M

T0 = datetime(2024, 1, 1)
INF = float("inf")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def samples(spark, points, kind="timestamp"):
    df = spark.createDataFrame([(s, at(t), float(v)) for s, t, v in points], "s string, ts timestamp, value double")
    return df.withColumn("ts", F.col("ts").cast(kind))


def test_histogram_counts_and_inf(spark, rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (99.0,), (None,)], "v double")
    assert rows(M.histogram(df, "v", [1, 2, 5])) == sorted(
        [(1.0, 1, 104.5, 4), (2.0, 2, 104.5, 4), (5.0, 3, 104.5, 4), (INF, 4, 104.5, 4)], key=repr)


def quantile(spark, counts, q, bounds=(1.0, 2.0, 4.0, INF)):
    df = spark.createDataFrame([("s", le, n) for le, n in zip(bounds, counts)], "s string, le double, n bigint")
    return M.histogram_quantile(df, q, ["s"]).first()["value"]


def test_quantiles(spark):
    assert quantile(spark, [0, 10, 10, 10], 0.5) == pytest.approx(1.5)
    assert quantile(spark, [4, 4, 8, 8], 0.25) == pytest.approx(0.5)   # first bucket starts at 0
    assert quantile(spark, [1, 2, 3, 10], 0.99) == 4.0                 # +Inf answers the last bound
    assert quantile(spark, [0, 0, 0, 0], 0.5) is None


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("segments", [2, None])
def test_increase_with_restart(spark, kind, segments):
    df = samples(spark, [("a", 0, 5), ("a", 10, 8), ("a", 20, 2), ("a", 50, 6), ("a", 70, 9), ("b", 5, 1)], kind)
    got = {(r.s, (r.start - T0).total_seconds()): r.increase
           for r in M.increase(df, ["s"], "1 minute", segments=segments).collect()}
    assert got == {("a", 0.0): 3 + 2 + 4, ("a", 60.0): 0.0, ("b", 0.0): 0.0}
    slid = {(r.s, (r.start - T0).total_seconds()): r.increase
            for r in M.increase(df, ["s"], "1 minute", "30 seconds", segments=segments).collect()}
    assert slid[("a", 30.0)] == 3.0 and slid[("a", -30.0)] == 5.0
    rates = M.rate(M.increase(df, ["s"], "1 minute", segments=segments))
    assert rates.where("s = 'a'").orderBy("start").first().rate == pytest.approx(9 / 60)
    assert {r.s: r.increase for r in M.increase_over_all(df, ["s"]).collect()} == {"a": 12.0, "b": 0.0}


def test_bucket_quantile_over_counters(spark):
    points = [(le, t, v) for t, row in [(0, (0, 0, 0)), (30, (5, 10, 10))] for le, v in zip((1.0, 2.0, INF), row)]
    df = spark.createDataFrame([("s", le, at(t), float(v)) for le, t, v in points], "s string, le double, ts timestamp, value double")
    assert M.bucket_quantile(df, ["s"], 0.75, "1 minute").first()["value"] == pytest.approx(1.5)


def test_ratio_and_series_ratio(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "s string, e int")
    assert rows(M.ratio(df, F.col("e") == 1, ["s"]).select("s", "ratio")) == [("a", 0.5), ("b", 0.0)]
    top = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "s string, rate double")
    bottom = spark.createDataFrame([("a", 4.0), ("b", 0.0)], "s string, rate double")
    assert rows(M.series_ratio(top, bottom, ["s"])) == [("a", 0.25), ("b", None)]


def test_lag_never_negative(spark, rows):
    df = spark.createDataFrame([("g", "t", 0, 5, 9), ("g", "t", 1, 12, 10), ("g", "u", 0, 0, 3)],
                               "grp string, topic string, partition int, position bigint, end_offset bigint")
    assert rows(M.consumer_lag(df)) == [("g", "t", 4), ("g", "u", 3)]


def test_gauge_latest(spark):
    df = samples(spark, [("a", 0, 1), ("a", 9, 3), ("a", 5, 2)])
    assert M.gauge_latest(df, ["s"]).first()["value"] == 3.0


def test_rolling_throughput_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    times = [rng.randrange(0, 400_000) / 1000 for _ in range(400)] + [60.0, 120.0, 120.0, 180.0, 0.0]
    df = samples(spark, [("a", t, 1) for t in times], "timestamp_ntz")
    got = {(r.ts - T0).total_seconds(): r.n for r in M.rolling_throughput(df, ["s"], 60).collect()}
    assert got == {t: sum(1 for u in times if t - 60 <= u <= t) for t in set(times)}


def test_rolling_throughput_adds_each_time_once(spark):
    """A sliding frame would cost the square of the rows in a busy minute."""
    df = samples(spark, [("a", 0, 1)])
    plan = M.rolling_throughput(df, ["s"], 60)._jdf.queryExecution().executedPlan().treeString()
    assert "RowFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan


def test_rolling_throughput_spreads_a_hot_series(spark):
    """The running counts of one series are carried across range cuts, none holds the series."""
    import random

    rng = random.Random(8)
    ticks = [rng.randrange(0, 200_000) for _ in range(3000)]  # hundredths of a second
    df = samples(spark, [("hot" if k % 4 else None, t / 100, 1) for k, t in enumerate(ticks)], "timestamp_ntz")
    got = {(r.s, round((r.ts - T0).total_seconds() * 100)): r.n for r in M.rolling_throughput(df, ["s"], 60, segments=9).collect()}
    by = {}
    for k, t in enumerate(ticks):
        by.setdefault("hot" if k % 4 else None, []).append(t)
    assert got == {(s, t): sum(1 for u in ts if t - 6000 <= u <= t) for s, ts in by.items() for t in set(ts)}


def test_windowed_counts(spark, rows):
    df = samples(spark, [("a", 0, 1), ("a", 599, 1), ("a", 600, 1)])
    assert sorted(r.n for r in M.windowed_counts(df, "10 minutes", ["s"]).collect()) == [1, 2]


@pytest.mark.parametrize("segments", [10, None])
def test_batches_of_32(spark, rows, segments):
    df = spark.range(70).select(F.lit("t").alias("topic"), "id")
    assert rows(M.embed_batches(df, ["topic"], ["id"], segments=segments)) == [("t", 0, 32), ("t", 1, 32), ("t", 2, 6)]


def test_series_key_ignores_label_order(spark):
    df = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "labels map<string,string>")
    assert {r.series for r in M.as_series(df).collect()} == {"a=2,b=1"}


def test_vector_match_rules(spark):
    import math

    import pytest

    left = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 0.0), ("b", "x", 1.0), (None, "x", 3.0)], "c string, t string, value double")
    right = spark.createDataFrame([("a", 4.0), ("b", 0.0), (None, 6.0), ("z", 1.0)], "c string, value double")
    got = {(r.c, r.t): r.value for r in M.vector_match(left, right, ["c", "t"], on=["c"], group="left").collect()}
    assert got[("a", "x")] == 0.5 and got[("a", "y")] == 0.0 and got[(None, "x")] == 0.5
    assert math.isinf(got[("b", "x")]) and len(got) == 4
    nan = M.vector_match(spark.createDataFrame([("b", 0.0)], "c string, value double"), right, ["c"]).collect()
    assert math.isnan(nan[0].value)
    with pytest.raises(Exception, match="many-to-many"):
        M.vector_match(right, left, ["c", "t"], on=["c"]).collect()
