"""Mergeable latency sketches: KLL per (series, time bucket), merged to any range.

A KLL sketch of `k` holds O(k log n) values whatever the number of samples, and two
sketches merge into one of the union. Sketches are built per series and bucket (10
minutes by default) with Spark's KLL aggregate, which combines partial sketches on
the map side, so a hot series is not gathered in one task. A quantile over any range
of buckets merges just those sketches; the samples are never read again.

With k = 200 the normalized rank error of a quantile is below RANK_ERROR[200] with
probability 0.99 (the bound of the KLL paper as DataSketches states it for one quantile).

Handled cases: null values are not counted; a series with no sample has no sketch;
null series are a series.
"""

from pyspark.sql import functions as F

K = 200
RANK_ERROR = {200: 0.0133}


def bucket_sketches(samples, series, ts, value, bucket="10 minutes", k=K):
    """(series.., start, n, sketch): one KLL sketch per series and bucket."""
    rows = samples.where(F.col(value).isNotNull())
    grouped = rows.groupBy(*series, F.window(ts, bucket)["start"].alias("start"))
    return grouped.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(sketches, series, start=None, end=None):
    """(series.., n, sketch): the sketches of buckets in [start, end) merged per series."""
    chosen = sketches
    if start is not None:
        chosen = chosen.where(F.col("start") >= F.lit(start))
    if end is not None:
        chosen = chosen.where(F.col("start") < F.lit(end))
    return chosen.groupBy(*series).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(merged_sketches, series, qs):
    """(series.., q, value): the sketch's estimate of each quantile."""
    # the rank must be a constant: one projection per quantile, each a narrow step
    values = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in qs]
    chosen = merged_sketches.select(*series, "n", F.explode(F.array(*values)).alias("_e"))
    return chosen.select(*series, "n", "_e.q", "_e.value")


def rank_errors(estimates, samples, series, value):
    """Estimates with the exact normalized rank range [low, high] of each value among the
    samples of its series, and `error`, the distance of q from that range."""
    keys = [*series, "q"]
    rows = samples.where(F.col(value).isNotNull()).select(*series, F.col(value).cast("double").alias("_v"))
    same = [estimates[c].eqNullSafe(rows[c]) for c in series]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    met = estimates.join(rows, condition, "left").select(*[estimates[c] for c in [*keys, "n", "value"]], rows["_v"])
    counted = met.groupBy(*keys, "n", "value").agg(
        F.count_if(F.col("_v") < F.col("value")).alias("below"), F.count_if(F.col("_v") <= F.col("value")).alias("upto"))
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    error = F.greatest(F.lit(0.0), low - F.col("q"), F.col("q") - high)
    return counted.select(*keys, "n", "value", low.alias("low"), high.alias("high"), error.alias("error"))
