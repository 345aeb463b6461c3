"""Counters, histograms, quantiles, rates and gauges over sample tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.config import DEFAULTS
from docpipe.operators.ordered import Ordered, epoch_micros

INF = float("inf")


# --- counters -----------------------------------------------------------------

def count_by(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def request_status(events, kind="event_type"):
    """success or error per request row."""
    return F.when(F.col(kind) == "error", "error").otherwise("success")


# --- histograms ---------------------------------------------------------------

def histogram(df, value, buckets, by=()):
    """Cumulative histogram: (by.., le, n, total, count), +Inf bucket included.

    One pass with one conditional count per bucket; rows are multiplied only
    after the aggregation.
    """
    bounds = [*buckets, INF]
    v = F.col(value)
    counts = [F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = df.where(v.isNotNull()).groupBy(*by).agg(
        *counts, F.sum(v.cast("double")).alias("total"), F.count("*").alias("count")
    )
    cells = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)
    ])
    return wide.select(*by, F.inline(cells), "total", "count")


def histogram_quantiles(buckets, quantiles, by=(), le="le", n="n"):
    """Quantiles {name: share} from cumulative buckets, linear inside a bucket.

    The first bucket starts at 0 (or at its bound, when that is not positive),
    the +Inf bucket answers with the last finite bound, and an empty histogram
    gives null. The window spans the buckets of one histogram only, and the
    aggregate reuses its partitioning.
    """
    order = Window.partitionBy(*by).orderBy(le)
    whole = Window.partitionBy(*by)
    marked = (
        buckets.withColumn("_low", F.lag(le).over(order))
        .withColumn("_below", F.coalesce(F.lag(n).over(order), F.lit(0)))
        .withColumn("_all", F.max(n).over(whole))
    )
    bound, count, below = F.col(le), F.col(n), F.col("_below")
    low = F.coalesce("_low", F.least(F.lit(0.0), bound))

    def first_reached(share):
        rank = F.lit(float(share)) * F.col("_all")
        value = (
            F.when(bound == INF, F.col("_low"))
            .when(F.col("_low").isNull() & (bound <= 0), bound)
            .when(count == below, low)
            .otherwise(low + (bound - low) * (rank - below) / (count - below))
        )
        return F.min_by(value, F.when((F.col("_all") > 0) & (count >= rank), bound))

    return marked.groupBy(*by).agg(*[first_reached(q).alias(name) for name, q in quantiles.items()])


def histogram_quantile(buckets, quantile, by=(), le="le", n="n"):
    """One quantile, as `value`."""
    return histogram_quantiles(buckets, {"value": quantile}, by, le, n)


# --- counters over time -------------------------------------------------------

def counter_steps(samples, series, ts="ts", value="value", tie=(), segments=None):
    """Add prev_<ts> and `step`, the growth since the sample before.

    A value below its predecessor is a restart: the counter grew by the new value.
    `tie` orders samples of one time. Without it copies of a sample are collapsed
    on the map side, as nothing else could split them.
    """
    if not tie:
        samples = samples.select(*series, ts, value).distinct()
        tie = [value]
    steps = Ordered(samples, list(series), [ts, *tie], segments).previous([ts, value])
    v, prev = F.col(value), F.col(f"prev_{value}")
    return steps.withColumn("step", F.when(prev.isNotNull(), F.when(v < prev, v).otherwise(v - prev)))


def increase(samples, series, window, slide=None, ts="ts", value="value", tie=(), segments=None):
    """Counter growth per series and window: (series.., start, end, increase).

    Steps count where both samples lie inside the window; no extrapolation to
    its edges. Sums are combined before the shuffle.
    """
    steps = counter_steps(samples, series, ts, value, tie, segments)
    spans = steps.withColumn("_w", F.window(ts, window, slide or window))
    inside = F.when(F.col(f"prev_{ts}") >= F.col("_w.start"), F.col("step")).otherwise(F.lit(0.0))
    return (
        spans.groupBy(*series, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"))
        .agg(F.sum(inside).alias("increase"))
    )


def increase_over_all(samples, series, ts="ts", value="value", tie=()):
    """Counter growth over the whole range of the table, per series."""
    steps = counter_steps(samples, series, ts, value, tie)
    return steps.groupBy(*series).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("increase"))


def _seconds(start, end, data_type):
    return (epoch_micros(F.col(end), data_type) - epoch_micros(F.col(start), data_type)) / F.lit(1_000_000.0)


def rate(increases):
    """Per-second growth of each window of `increase`."""
    kind = increases.schema["start"].dataType
    return increases.withColumn("rate", F.col("increase") / _seconds("start", "end", kind))


def bucket_quantile(samples, series, quantile, window, slide=None, le="le", ts="ts", value="value"):
    """histogram_quantile over the rate of cumulative bucket counters per window."""
    grown = increase(samples, [*series, le], window, slide, ts, value)
    return histogram_quantile(grown, quantile, [*series, "start", "end"], le, "increase")


def ratio(df, part, by=(), whole=None):
    """Share of rows (or of a weight) that satisfies `part`: (by.., part, whole, ratio)."""
    weight = F.lit(1) if whole is None else whole
    sums = df.groupBy(*by).agg(
        F.sum(F.when(part, weight).otherwise(F.lit(0))).alias("part"), F.sum(weight).alias("whole")
    )
    return sums.withColumn("ratio", F.col("part") / F.nullif(F.col("whole"), F.lit(0)))


def series_ratio(numerator, denominator, on, value="rate"):
    """Division of two series tables matched on their labels; 0 / 0 gives null."""
    top = numerator.withColumnRenamed(value, "_part")
    bottom = denominator.select(*on, F.col(value).alias("_whole"))
    joined = top.join(bottom, list(on))
    return joined.withColumn("ratio", F.col("_part") / F.nullif(F.col("_whole"), F.lit(0.0))).drop("_part", "_whole")


def vector_match(left, right, labels, at=(), on=None, ignoring=(), group=None, value="value", op="/"):
    """A binary operation between two instant-vector tables, with the label matching of
    the rule language: rows match on `on` labels if given, else on all `labels` but
    `ignoring`, and at equal `at` (evaluation time) columns.

    group: None for one-to-one (both sides unique per match), "left" for many left rows
    per right row (group_left), "right" the other way. A match key that is repeated on a
    side that must be unique fails the query with an error naming it, as the rule
    language does; keys without a partner give no row. Result labels: one-to-one keeps
    the `on` labels (or all but `ignoring`), a grouped match keeps the labels of the many
    side. Division follows floating point: x / 0 is an infinity, 0 / 0 is NaN.
    """
    key = [*at, *(list(on) if on is not None else [c for c in labels if c not in ignoring])]
    unique = {None: ("l", "r"), "left": ("r",), "right": ("l",)}[group]

    def side(df, name):
        if name not in unique:  # the many side is not counted, so a hot key is not gathered
            return df.withColumn(f"_{name}_n", F.lit(1))
        counted = df.withColumn(f"_{name}_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
        if name in unique:
            counted = counted.withColumn(f"_{name}_n", F.when(
                F.col(f"_{name}_n") > 1,
                F.raise_error(F.concat(F.lit(f"many-to-many matching: repeated match on the {'left' if name == 'l' else 'right'} side for "),
                                       F.to_json(F.struct(*key))))).otherwise(F.col(f"_{name}_n")))
        return counted

    kept = key if group is None else [*at, *labels]
    many = right if group == "right" else left
    other = left if group == "right" else right
    a = side(many, "r" if group == "right" else "l").alias("a")
    b = side(other, "l" if group == "right" else "r").alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = a.join(b, condition)
    x, y = (F.col(f"b.{value}"), F.col(f"a.{value}")) if group == "right" else (F.col(f"a.{value}"), F.col(f"b.{value}"))
    x, y = x.cast("double"), y.cast("double")
    if op == "/":
        result = F.when(y != 0, x / y).when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).when(
            x < 0, F.lit(float("-inf")))
    else:
        result = {"+": x + y, "-": x - y, "*": x * y}[op]
    checks = [F.col(f"{s}._{n}_n") for s, n in (("a", "r" if group == "right" else "l"), ("b", "l" if group == "right" else "r"))]
    guarded = F.when(checks[0].isNotNull() & checks[1].isNotNull(), result)
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in dict.fromkeys(kept)], guarded.alias(value))


# --- gauges -------------------------------------------------------------------

def consumer_lag(offsets, by=("grp", "topic")):
    """Rows still to read: sum of max(0, end - position) over partitions."""
    behind = F.greatest(F.lit(0), F.col("end_offset") - F.col("position"))
    return offsets.groupBy(*by).agg(F.sum(behind).alias("lag"))


def gauge_latest(samples, series, ts="ts", value="value", tie=()):
    """The last value per series."""
    newest = F.struct(ts, *tie)
    return samples.groupBy(*series).agg(
        F.max(ts).alias(ts), F.max_by(value, newest).alias(value)
    )


def rolling_throughput(events, series, seconds=DEFAULTS.throughput_window_seconds, ts="ts", segments=None):
    """Events in the `seconds` up to each event time, both ends included, and the rate.

    One row per series and distinct time. Times are counted first; then each time
    t becomes a row of its count and a probe at t - seconds with none, and both are put
    in one order per series by range cuts (a hot series spans many cuts). The running
    sum of counts in that order is, at t, the events up to t, and at the probe, which
    sorts before an equal time, the events before t - seconds; their difference is the
    window. No group per series and span is formed, and the work is linear in the rows.
    """
    width = seconds * 1_000_000
    micros = epoch_micros(F.col(ts), events.schema[ts].dataType)
    counted = (
        events.select(*series, F.col(ts).alias("ts"), micros.alias("_us"))
        .groupBy(*series, "ts", "_us").agg(F.count("*").alias("_n"))
    )
    data = counted.select(*series, "ts", F.col("_us").alias("_k"), F.lit(1).alias("_kind"), "_n")
    probes = counted.select(*series, "ts", (F.col("_us") - F.lit(width)).alias("_k"), F.lit(0).alias("_kind"),
                            F.lit(0).cast("bigint").alias("_n"))
    summed = Ordered(data.unionByName(probes), list(series), ["_k", "_kind"], segments).running_sum("_n", "_s")
    upto = summed.where("_kind = 1").select(*series, "ts", F.col("_s").alias("_upto"))
    before = summed.where("_kind = 0").select(*[F.col(c).alias(f"_b_{c}") for c in series], F.col("ts").alias("_b_ts"),
                                              F.col("_s").alias("_before"))
    same = F.col("ts") == F.col("_b_ts")
    for c in series:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    n = (F.col("_upto") - F.col("_before")).alias("n")
    joined = upto.join(before, same).select(*series, "ts", n)
    return joined.select(*series, "ts", "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def windowed_counts(events, window, keys=(), slide=None, ts="ts"):
    """Row counts per tumbling (or sliding) window and key."""
    return (
        events.groupBy(F.window(ts, window, slide or window).alias("_w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")
    )


def embed_batches(rows, topic, order, batch_size=DEFAULTS.embed_batch_size, segments=None):
    """(topic.., batch_no, n): arrival-ordered batches of at most `batch_size` per topic."""
    numbered = Ordered(rows, list(topic), list(order), segments).row_number("_row")
    batch = F.floor((F.col("_row") - 1) / F.lit(batch_size)).cast("bigint")
    return numbered.groupBy(*topic, batch.alias("batch_no")).agg(F.count("*").alias("n"))


# --- combining series ---------------------------------------------------------

def both(left, right, on):
    """Rows of `left` whose labels and time also occur in `right`."""
    return left.join(right.select(*on), list(on), "left_semi")


def as_series(samples):
    """Samples with `labels` as a sorted, groupable `series` column."""
    entries = F.array_sort(F.map_entries("labels"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return samples.withColumn("series", text)
