import datetime as dt
import random

from pyspark.sql import functions as F

from docpipe.operators import sketches


def test_merged_sketches_stay_within_their_rank_bound_on_a_hot_series(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot" if k % 3 else rng.choice(["a", "b", None]), start + dt.timedelta(seconds=k * 7), rng.lognormvariate(3, 1)) for k in range(30000)]
    rows += [("a", start, None)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    stored = sketches.bucket_sketches(df, ["s"], "ts", "v").cache()
    assert stored.where("s = 'hot'").count() > 300  # one sketch per 10 minutes
    whole = sketches.quantiles(sketches.merged(stored, ["s"]), ["s"], (0.01, 0.5, 0.99))
    errors = sketches.rank_errors(whole, df, ["s"], "v").collect()
    assert len(errors) == 12 and all(r.error <= sketches.RANK_ERROR[sketches.K] for r in errors)
    counts = {r.s: r.n for r in errors}
    assert counts["hot"] == 20000
    part = sketches.merged(stored, ["s"], start=start, end=start + dt.timedelta(hours=6))
    assert {r.s: r.n for r in part.collect()}["hot"] == df.where((F.col("s") == "hot") & (F.col("ts") < start + dt.timedelta(hours=6))).count()
