"""Table and event schemas, column limits and metric constants."""

from pyspark.sql import types as T

# The fields of page and chunk events and of the vector table.
PAGE_EVENT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("crawled_at", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])

CHUNK_EVENT = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("total_chunks", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("created_at", T.LongType()),
])

CHUNK_VECTOR = T.StructType(
    CHUNK_EVENT.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)

SEEN_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])

SAMPLE = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("value", T.DoubleType()),
])

# Byte limits of the vector table's text columns.
BYTE_LIMITS = {
    "chunk_id": 64,
    "url": 2048,
    "title": 512,
    "text": 4096,
    "content_hash": 64,
}

# The columns a search returns next to the score.
HIT_COLUMNS = ["chunk_id", "url", "title", "chunk_index", "total_chunks", "text"]

# Upper bounds of the histogram buckets, per metric.
BUCKETS = {
    "chunker_chunk_size_tokens": [64, 128, 256, 384, 512, 640],
    "chunker_chunks_per_page": [1, 2, 5, 10, 20, 50],
    "embedding_inference_latency_seconds": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0],
    "embedding_milvus_insert_latency_seconds": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5],
    "embedding_batch_size": [1, 4, 8, 16, 32, 64],
    "embedding_api_latency_seconds": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1],
    "query_api_latency_seconds": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0],
    "query_api_embed_call_latency_seconds": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25],
    "query_api_milvus_search_latency_seconds": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25],
}
