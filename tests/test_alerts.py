from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.operators import alerts as A
from docpipe.schemas import SAMPLE

T0 = datetime(2024, 1, 1)


def checks(spark, active, missing=()):
    data = [("s", T0 + timedelta(seconds=30 * i), bool(a)) for i, a in enumerate(active) if i not in missing]
    return spark.createDataFrame(data, "series string, ts timestamp, active boolean")


def states(spark, active, hold, missing=()):
    out = A.alert_states(checks(spark, active, missing), ["series"], hold, 30)
    return [r.state[0] for r in out.orderBy("ts").collect()]


def test_fires_after_hold(spark):
    assert states(spark, [0, 1, 1, 1, 0, 1], 60) == list("ippfip")


def test_gap_restarts_the_clock(spark):
    assert states(spark, [1, 1, 1, 1, 1], 60, missing=(2,)) == list("pppp")


def test_zero_hold_fires_at_once(spark):
    assert states(spark, [1, 0], 0) == list("fi")


def test_a_long_series_across_range_cuts_equals_a_walk(spark):
    """The series is cut into many ranges; streak starts and gaps carry across the cuts."""
    import random

    rng = random.Random(4)
    active = [rng.random() < 0.8 for _ in range(600)]
    missing = {k for k in range(600) if rng.random() < 0.03}
    out = A.alert_states(checks(spark, active, missing), ["series"], 90, 30, segments=13)
    got = [r.state[0] for r in out.orderBy("ts").collect()]
    want, since, last = [], None, None
    for i, a in enumerate(active):
        if i in missing:
            continue
        if not a:
            since = None
        elif since is None or last is None or i - last > 1 or not active[last]:
            since = i
        last = i
        want.append("i" if not a else "f" if (i - since) * 30 >= 90 else "p")
    assert got == want


def metric(name, points, **labels):
    return [(T0 + timedelta(seconds=t), name, labels, float(v)) for t, v in points]


@pytest.fixture(scope="module")
def evaluated(spark):
    every = range(0, 1200, 30)
    data = metric("chunker_kafka_consumer_lag", [(t, 25) for t in every], job="chunker")
    data += metric("embedding_kafka_consumer_lag", [(t, 60) for t in every], job="embedding")
    data += metric("embedding_throughput_chunks_per_sec", [(t, 0) for t in every], job="embedding")
    data += metric("kafka_server_under_replicated_partitions", [(t, 1 if t >= 600 else 0) for t in every])
    for le, share in [("0.1", 0.5), ("0.5", 0.6), ("1.0", 1.0), ("+Inf", 1.0)]:
        data += metric("query_api_latency_seconds_bucket", [(t, share * t) for t in every], le=le, pod="q")
        data += metric("embedding_milvus_insert_latency_seconds_bucket", [(t, share * t) for t in every], le=le)
    data += metric("query_api_requests_total", [(t, t) for t in every], status="success", pod="q")
    data += metric("query_api_requests_total", [(t, 0.1 * t) for t in every], status="error", pod="q")
    samples = spark.createDataFrame(data, SAMPLE)
    return A.evaluate(samples).cache()


def at_end(evaluated):
    at = F.lit(T0 + timedelta(seconds=1200)).cast("timestamp")
    return [(r.severity, r.alertname, r.state) for r in A.active_alerts(evaluated, at).collect()]


def test_rule_set(evaluated):
    assert at_end(evaluated) == [
        ("critical", "ChunkerKafkaLagCritical", "firing"),
        ("critical", "QueryApiHighErrorRate", "firing"),
        ("warning", "EmbeddingThroughputZero", "firing"),
        ("warning", "KafkaUnderReplicatedPartitions", "firing"),
        ("warning", "QueryApiHighP99Latency", "firing"),
    ]


def test_hold_times(evaluated):
    first = {r.alertname: (r.t - T0).total_seconds() for r in evaluated.where("state = 'firing'")
             .groupBy("alertname").agg(F.min("ts").alias("t")).collect()}
    assert first["ChunkerKafkaLagCritical"] == 300      # first evaluation at 0 s
    assert first["EmbeddingThroughputZero"] == 600
    assert first["KafkaUnderReplicatedPartitions"] == 720


@pytest.mark.parametrize("times", [
    [30 * i + (0.1 if i % 2 else -0.1) for i in range(1, 40)], [60 * i + 7 for i in range(20)], [240 * i for i in range(6)]])
def test_gauges_fire_whatever_the_scrape_times(spark, times):
    """Jitter, long scrape intervals and scrapes off the grid end no alert."""
    data = metric("chunker_kafka_consumer_lag", [(t, 100) for t in times])
    states = A.evaluate(spark.createDataFrame(data, SAMPLE), A.RULES[:1])
    firing = states.where("state = 'firing'").agg(F.min("ts").alias("t")).first().t
    start = -(-min(times) // 30) * 30
    assert (firing - T0).total_seconds() == start + 300


def test_a_stale_gauge_ends_its_alert(spark):
    data = metric("chunker_kafka_consumer_lag", [(0, 100), (900, 100)])
    got = [(r.ts - T0).total_seconds() for r in A.evaluate(spark.createDataFrame(data, SAMPLE), A.RULES[:1]).collect()]
    assert max(t for t in got if t < 900) == 270 and 300 not in got


def test_resolved_series_are_not_active(evaluated):
    late = F.lit(T0 + timedelta(hours=3)).cast("timestamp")
    assert A.active_alerts(evaluated, late).count() == 0


def test_dashboard_panels(spark):
    from docpipe.plans import dashboard as D

    every = range(0, 601, 30)
    data = metric("crawler_pages_emitted_total", [(t, t / 30) for t in every])
    data += metric("crawler_pages_skipped_total", [(t, t / 10) for t in every])
    data += metric("crawler_pages_crawled_total", [(t, t / 5) for t in every])
    data += metric("kafka_log_size_bytes", [(t, 1000 + t) for t in every], topic="page.crawled")
    data += metric("query_api_requests_total", [(t, t) for t in every], status="success")
    data += metric("query_api_requests_total", [(t, t / 4) for t in every], status="error")
    for le, share in [("1", 0.0), ("2", 1.0), ("+Inf", 1.0)]:
        data += metric("chunker_chunks_per_page_bucket", [(t, share * t) for t in every], le=le)
    samples = spark.createDataFrame(data, SAMPLE).cache()
    assert D.panel(samples, "pages_emitted").first().increase == 20.0
    assert D.panel(samples, "log_size").first().value == 1600.0
    assert D.panel(samples, "skip_ratio").orderBy("start").first().ratio == pytest.approx(0.5)
    assert D.panel(samples, "error_rate").orderBy("start").first().ratio == pytest.approx(0.2)
    shares = {r["quantile"]: r["value"] for r in D.panel(samples, "chunks_per_page").where("value is not null").collect()}
    assert shares[0.5] == pytest.approx(1.5) and shares[0.95] == pytest.approx(1.95)
    for name in D.panel_names():
        D.panel(samples, name).schema
    assert D.alerts_panel(samples, F.lit(T0), rules=A.RULES[:1]).count() == 0
