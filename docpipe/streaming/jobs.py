"""The stages as checkpointed streaming queries.

Each query hands complete micro-batches to the batch operators. A batch is
written under its id before the state that depends on it, and a batch already
complete is not written again, so a restart repeats nothing and loses nothing.
"""

import json
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.config import DEFAULTS
from docpipe.operators.changes import page_versions
from docpipe.operators.chunks import chunk_rows
from docpipe.operators.extract import extract_pages, nonempty
from docpipe.operators.index import assign_cells
from docpipe.operators.metrics import windowed_counts
from docpipe.operators.ordered import epoch_micros
from docpipe.operators.quality import quarantine, with_event_defaults
from docpipe.sources.events import parse_events
from docpipe.sources.state import BatchFolder

SNAPSHOT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("crawled_at", T.TimestampType()),
])
PAGE_TABLE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("crawled_at", T.TimestampType()),
    T.StructField("content_hash", T.StringType()),
])
CHUNK_TABLE = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("total_chunks", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("version", T.LongType()),
])


@contextmanager
def persisted(df):
    """`df` kept for several uses, and released whatever happens."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _run(stream, step, checkpoint, once, seconds):
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def snapshot_stream(spark, path, max_files=None):
    reader = spark.readStream.schema(SNAPSHOT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


def change_query(snapshots, pages_path, seen, checkpoint, once=True, seconds=DEFAULTS.batch_seconds):
    """Snapshots -> table of new or changed pages, against the seen-pages state."""
    out = BatchFolder(pages_path, PAGE_TABLE)

    def step(batch, batch_id):
        spark = batch.sparkSession
        with persisted(nonempty(batch)) as pages:  # used for the state lookup and the comparison
            known = seen.read(spark, before=batch_id, urls=pages.select("url"))
            out.write(page_versions(pages, known, ["crawled_at", "content_hash"]), batch_id)
        emitted = out.read(spark, after=batch_id - 1, before=batch_id + 1)
        newest = emitted.groupBy("url").agg(
            F.max_by("content_hash", F.struct("crawled_at", "content_hash")).alias("content_hash"))
        seen.write(newest, batch_id)

    return _run(extract_pages(snapshots), step, checkpoint, once, seconds)


def chunk_query(pages, chunks_path, checkpoint, size=DEFAULTS.chunk_size, overlap=DEFAULTS.chunk_overlap,
                tokenizer=None, once=True, seconds=DEFAULTS.batch_seconds, created_at=None):
    """Changed pages -> chunk table. `version` orders contents of one url."""
    out = BatchFolder(chunks_path, CHUNK_TABLE)

    def step(batch, batch_id):
        rows = chunk_rows(batch, size, overlap, tokenizer, created_at, keep=["crawled_at"])
        out.write(rows.withColumn("version", F.unix_micros("crawled_at")), batch_id)

    return _run(nonempty(pages), step, checkpoint, once, seconds)


def vector_query(chunks, table, embedder, checkpoint, centroids=None, dead_path=None, strict=False,
                 once=True, seconds=DEFAULTS.batch_seconds):
    """Chunk table -> vector table. Rows that cannot be stored go to `dead_path`."""
    def step(batch, batch_id):
        ready = with_event_defaults(batch)
        with persisted(embedder.transform(ready, "text", "embedding")) as rows:  # the model runs once per row
            kept, dead = quarantine(rows, embedder.dim, strict=strict)
            cells = assign_cells(kept, centroids) if centroids is not None else kept.withColumn("cell", F.lit(0))
            table.write(cells, batch_id)
            if dead_path:
                BatchFolder(dead_path, dead.drop("embedding").schema).write(dead.drop("embedding"), batch_id)

    return _run(chunks, step, checkpoint, once, seconds)


def event_query(raw, schema, good_path, dead_path, checkpoint, mandatory=(), once=True,
                seconds=DEFAULTS.batch_seconds):
    """Raw JSON messages (`value`) -> decoded events and a dead-letter table."""
    good_out = BatchFolder(good_path, schema)
    dead_out = BatchFolder(dead_path, T.StructType([
        T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())]))

    def step(batch, batch_id):
        with persisted(parse_events(batch, schema, mandatory=mandatory)) as parsed:
            good_out.write(parsed.where("reason is null"), batch_id)
            dead_out.write(parsed.where("reason is not null"), batch_id)

    return _run(raw, step, checkpoint, once, seconds)


def without_redelivery(events, ts="crawled_at", retention=DEFAULTS.retention):
    """Drop repeats of (url, content_hash) within the retention time.

    For redelivered messages only: a page that returns to earlier content looks
    the same, so change detection is left to `change_query`.
    """
    return events.withWatermark(ts, retention).dropDuplicatesWithinWatermark(["url", "content_hash"])


def stage_counts(events, window="10 minutes", keys=("event_type",), ts="ts", late=DEFAULTS.retention):
    """Closed windows of event counts, for append mode."""
    moment = F.timestamp_micros(epoch_micros(F.col(ts), events.schema[ts].dataType))
    typed = events.withColumn(ts, moment).withWatermark(ts, late)
    return windowed_counts(typed, window, keys, ts=ts)


def offset_rows(progress):
    """(topic, partition, position, end_offset) rows of a Kafka query's progress,
    the input of `metrics.consumer_lag`."""
    rows = []
    for source in progress.get("sources", []):
        ends, heads = source.get("endOffset") or {}, source.get("latestOffset") or {}
        ends = json.loads(ends) if isinstance(ends, str) else ends
        heads = json.loads(heads) if isinstance(heads, str) else heads
        for topic, parts in heads.items():
            for part, head in parts.items():
                rows.append((topic, int(part), int(ends.get(topic, {}).get(part, 0)), int(head)))
    return rows
