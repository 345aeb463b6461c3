"""The dashboard panels over one table of samples (ts, metric, labels, value).

Each panel is a DataFrame with its labels as `series`. Bucket counters carry the
label `le`, request counters `status`.
"""

from pyspark.sql import functions as F

from docpipe.operators import alerts as A
from docpipe.operators import metrics as M

# Panel -> metric (and window or quantiles).
TOTALS = {
    "pages_emitted": "crawler_pages_emitted_total",
    "chunks_produced": "chunker_chunks_produced_total",
    "chunks_embedded": "embedding_chunks_embedded_total",
}
GAUGES = {
    "embedding_throughput": ["embedding_throughput_chunks_per_sec"],
    "consumer_lag": ["chunker_kafka_consumer_lag", "embedding_kafka_consumer_lag"],
    "replicas": ["kube_deployment_spec_replicas", "kube_deployment_status_replicas_ready"],
    "sitemap_urls": ["crawler_sitemap_urls_found"],
    "broker_messages": ["kafka_topic_messages_in_per_sec"],
    "broker_bytes": ["kafka_topic_BytesInPerSec_rate", "kafka_topic_BytesOutPerSec_rate"],
    "log_size": ["kafka_log_size_bytes"],
}
GROWTH = {
    "crawler_activity": (["crawler_pages_crawled_total", "crawler_pages_emitted_total",
                          "crawler_pages_skipped_total", "crawler_pages_errored_total"], "10 minutes"),
}
RATES = {
    "chunker_output": ("chunker_chunks_produced_total", "1 minute"),
    "embedding_errors": ("embedding_errors_total", "5 minutes"),
    "request_rate": ("query_api_requests_total", "1 minute"),
}
QUANTILES = {
    "chunks_per_page": ("chunker_chunks_per_page_bucket", "10 minutes", [0.50, 0.95]),
    "chunk_size": ("chunker_chunk_size_tokens_bucket", "10 minutes", [0.50, 0.95]),
    "inference_latency": ("embedding_inference_latency_seconds_bucket", "5 minutes", [0.50, 0.99]),
    "insert_latency": ("embedding_milvus_insert_latency_seconds_bucket", "5 minutes", [0.99]),
    "embed_batch_size": ("embedding_batch_size_bucket", "5 minutes", [0.50]),
    "query_latency": ("query_api_latency_seconds_bucket", "5 minutes", [0.50, 0.99]),
    "embed_call_latency": ("query_api_embed_call_latency_seconds_bucket", "5 minutes", [0.99]),
    "search_latency": ("query_api_milvus_search_latency_seconds_bucket", "5 minutes", [0.99]),
    "embed_api_latency": ("embedding_api_latency_seconds_bucket", "5 minutes", [0.99]),
}


def _metric(samples, *names):
    return M.as_series(samples.where(F.col("metric").isin(*names)))


def panel(samples, name):
    """One panel by name; see `panel_names`."""
    if name in TOTALS:
        return M.increase_over_all(_metric(samples, TOTALS[name]), ["series"])
    if name in GAUGES:
        return M.gauge_latest(_metric(samples, *GAUGES[name]), ["metric", "series"])
    if name in GROWTH:
        metrics, window = GROWTH[name]
        return M.increase(_metric(samples, *metrics), ["metric", "series"], window)
    if name in RATES:
        metric, window = RATES[name]
        return M.rate(M.increase(_metric(samples, metric), ["series"], window))
    if name in QUANTILES:
        metric, window, shares = QUANTILES[name]
        buckets = A.with_bounds(samples.where(F.col("metric") == metric))
        parts = [
            M.bucket_quantile(buckets, ["series"], q, window).withColumn("quantile", F.lit(q)) for q in shares
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if name == "error_rate":
        return A.error_share(samples.where(F.col("metric") == "query_api_requests_total"), "5 minutes")
    if name == "skip_ratio":
        skipped = M.rate(M.increase(_metric(samples, "crawler_pages_skipped_total"), ["series"], "10 minutes"))
        crawled = M.rate(M.increase(_metric(samples, "crawler_pages_crawled_total"), ["series"], "10 minutes"))
        return M.series_ratio(skipped, crawled, ["series", "start", "end"]).drop("increase")
    raise KeyError(name)


def panel_names():
    return [*TOTALS, *GAUGES, *GROWTH, *RATES, *QUANTILES, "error_rate", "skip_ratio"]


def alerts_panel(samples, at, rules=A.RULES, step=30):
    return A.active_alerts(A.evaluate(samples, rules, step), at, step)
