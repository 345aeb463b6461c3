"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docpipe.plans.catalog import QUERIES
from docpipe.session import build_session

HEADLINE = [
    "page_extract", "changed_pages", "page_versions", "page_events_json", "json_events",
    "chunk_rows", "chunk_windows_small", "upsert_chunks", "constraint_violations",
    "hash_embed_dense", "hash_embed_sparse",
    "exact_search", "exact_search_k50", "assign_cells", "text_search", "page_search", "ivf_search",
    "latency_quantiles", "counter_increase", "rolling_throughput", "embed_batches",
    "windowed_counts", "gauge_latest", "alert_states",
]


def rows_of(df):
    """Run the query to the end; return its row count."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("docpipe-bench", f"local[{cpus}]", cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="16g", spark__docpipe__spread=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/pages.parquet").count()  # start-up is not part of a query

    cold, times, rows = {}, {}, {}
    for name in wanted:
        for taken in (cold, times):
            started = time.perf_counter()
            rows[name] = rows_of(QUERIES[name](spark, sf_dir))
            taken[name] = round(time.perf_counter() - started, 3)
        print(name, cold[name], times[name], rows[name], file=sys.stderr, flush=True)

    derived = {}
    if "chunk_rows" in times:
        derived["chunks_per_second"] = round(rows["chunk_rows"] / times["chunk_rows"], 1)
    if "page_extract" in times:
        derived["pages_per_second"] = round(rows["page_extract"] / times["page_extract"], 1)
    if "text_search" in times:
        queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
        derived["text_queries_per_second"] = round(queries / times["text_search"], 1)
        if "chunk_rows" in rows:
            derived["query_chunk_pairs_per_second"] = round(queries * rows["chunk_rows"] / times["text_search"])
    print(json.dumps({
        "metric": "docpipe headline queries, second run of each in one session",
        "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_run": cold, "rows": rows, "derived": derived, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
