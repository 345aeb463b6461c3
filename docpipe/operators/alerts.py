"""Alert rules: a condition per evaluation time, and how long it must hold."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from docpipe.operators import metrics as M
from docpipe.operators.ordered import Ordered, epoch_micros


def alert_states(checks, series, hold_seconds, step_seconds, ts="ts", active="active", segments=None):
    """Add active_since and state (inactive, pending, firing) to rule evaluations.

    checks: one row per series and evaluation time with a boolean. A time missing
    for longer than `step_seconds` ends the alert. Evaluations are aggregates on
    a time grid, so a series has one row per grid step however many samples
    went into it.

    A long series is not held in one task: its rows are dealt out by range cuts of
    (series, time); the row before each one comes with a carry from the cut before,
    and the start of the current streak is a running maximum of the streak starts
    so far, carried across cuts by the maximum of each cut.
    """
    us = epoch_micros(F.col(ts), checks.schema[ts].dataType)
    on = F.coalesce(F.col(active), F.lit(False))
    rows = checks.withColumn("_us", us).withColumn("_on", on)
    rows = Ordered(rows, list(series), ["_us"], segments).previous(["_on", "_us"])
    starts = F.col("_on") & (
        F.col("prev__on").isNull() | ~F.col("prev__on") | ((F.col("_us") - F.col("prev__us")) > step_seconds * 1_000_000)
    )
    rows = rows.withColumn("_start", F.when(starts, F.struct(F.col("_us").alias("us"), F.col(ts).alias("at"))))
    rows = Ordered(rows, list(series), ["_us"], segments).running_max("_start", "_since")
    rows = rows.withColumn("active_since", F.when(F.col("_on"), F.col("_since.at")))
    held = (F.col("_us") - F.col("_since.us")) >= hold_seconds * 1_000_000
    state = F.when(~F.col("_on"), "inactive").when(held, "firing").otherwise("pending")
    return rows.withColumn("state", state).drop("_us", "_on", "prev__on", "prev__us", "_start", "_since")


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    component: str
    hold_seconds: int
    threshold: float
    kind: str
    metric: str
    other: str = ""


# The rule set, with thresholds as defaults.
RULES = [
    Rule("ChunkerKafkaLagCritical", "critical", "chunker", 300, 20, "gauge", "chunker_kafka_consumer_lag"),
    Rule("EmbeddingKafkaLagCritical", "critical", "embedding-service", 300, 80, "gauge", "embedding_kafka_consumer_lag"),
    Rule("QueryApiHighP99Latency", "warning", "query-api", 300, 0.5, "p99", "query_api_latency_seconds_bucket"),
    Rule("QueryApiHighErrorRate", "critical", "query-api", 120, 0.05, "errors", "query_api_requests_total"),
    Rule("MilvusInsertLatencyHigh", "warning", "milvus", 300, 1.0, "p99", "embedding_milvus_insert_latency_seconds_bucket"),
    Rule("EmbeddingThroughputZero", "warning", "embedding-service", 600, 0, "stalled",
         "embedding_throughput_chunks_per_sec", "embedding_kafka_consumer_lag"),
    Rule("KafkaUnderReplicatedPartitions", "warning", "kafka", 120, 0, "gauge", "kafka_server_under_replicated_partitions"),
]


def _drop_label(samples, label):
    """Samples whose series ignores one label, kept as its own column."""
    rest = F.map_filter("labels", lambda k, _: k != label)
    return samples.withColumn(label, F.col("labels")[label]).withColumn("labels", rest)


STALE_SECONDS = 300


def on_grid(samples, step, stale=STALE_SECONDS):
    """The newest value per series at every grid time, at most `stale` seconds old.

    Each sample answers the grid times from its own on, until it is stale; of several the
    newest wins. Scrapes need not hit the grid, nor come once per step. Combined on
    the map side. Of samples of one series and time the larger value counts.
    """
    kind = samples.schema["ts"].dataType
    us, width = epoch_micros(F.col("ts"), kind), step * 1_000_000
    first = F.ceil(us / F.lit(width))
    last = F.ceil((us + F.lit(stale * 1_000_000)) / F.lit(width)) - 1
    covered = samples.withColumn("_us", us).withColumn("_at", F.explode(F.sequence(first, last)))
    newest = covered.where(last >= first).groupBy("series", "_at").agg(F.max(F.struct("_us", "value")).alias("_v"))
    return newest.select("series", F.timestamp_micros(F.col("_at") * width).cast(kind).alias("ts"), F.col("_v.value").alias("value"))


def with_bounds(bucket_samples):
    """Bucket counters with `le` as a number and the other labels as `series`."""
    le = F.when(F.col("le") == "+Inf", F.lit(M.INF)).otherwise(F.col("le").try_cast("double"))
    return M.as_series(_drop_label(bucket_samples, "le")).withColumn("le", le)


def error_share(request_samples, window, slide=None):
    """Failed requests over all requests, per series and window."""
    by_status = M.as_series(_drop_label(request_samples, "status"))
    grown = M.increase(by_status, ["series", "status"], window, slide)
    return M.ratio(grown, F.col("status") == "error", ["series", "start", "end"], F.col("increase"))


def check(samples, rule, step=30, lookback="5 minutes", stale=STALE_SECONDS):
    """(series, ts, active) of one rule on a grid of `step` seconds.

    samples: (ts, metric, labels, value); bucket counters carry the label `le`,
    request counters the label `status`.
    """
    mine = samples.where(F.col("metric") == rule.metric)
    slide = f"{step} seconds"
    if rule.kind == "gauge":
        return on_grid(M.as_series(mine), step, stale).select(
            "series", "ts", (F.col("value") > rule.threshold).alias("active"))
    if rule.kind == "p99":
        p99 = M.bucket_quantile(with_bounds(mine), ["series"], 0.99, lookback, slide)
        return p99.select("series", F.col("end").alias("ts"), (F.col("value") > rule.threshold).alias("active"))
    if rule.kind == "errors":
        share = error_share(mine, lookback, slide)
        return share.select("series", F.col("end").alias("ts"), (F.col("ratio") > rule.threshold).alias("active"))
    if rule.kind == "stalled":
        idle = on_grid(M.as_series(mine), step, stale).where("value = 0")
        waiting = on_grid(M.as_series(samples.where(F.col("metric") == rule.other)), step, stale).where("value > 0")
        return M.both(idle, waiting, ["series", "ts"]).select("series", "ts", F.lit(True).alias("active"))
    raise ValueError(f"unknown rule kind: {rule.kind}")


def evaluate(samples, rules=RULES, step=30, lookback="5 minutes", stale=STALE_SECONDS):
    """States of all rules: (alertname, severity, component, series, ts, active_since, state)."""
    parts = []
    for rule in rules:
        states = alert_states(check(samples, rule, step, lookback, stale), ["series"], rule.hold_seconds, step)
        parts.append(states.select(
            F.lit(rule.name).alias("alertname"), F.lit(rule.severity).alias("severity"),
            F.lit(rule.component).alias("component"), "series", "ts", "active_since", "state",
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


def active_alerts(states, at, step=30):
    """Alert series pending or firing at time `at`, most severe first.

    Series without an evaluation in the last `step` seconds have resolved.
    """
    fresh = states.where((F.col("ts") <= at) & (F.col("ts") > at - F.expr(f"interval {step} seconds")))
    latest = fresh.groupBy("alertname", "severity", "component", "series").agg(
        F.max("ts").alias("ts"), F.max_by("state", "ts").alias("state"),
        F.max_by("active_since", "ts").alias("active_since"),
    )
    return latest.where("state <> 'inactive'").orderBy("severity", "alertname", "series")
