"""Page and chunk events as JSON messages."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.functions.text import iso_utc
from docpipe.schemas import CHUNK_EVENT, PAGE_EVENT


def parse_events(raw, schema, value="value", mandatory=()):
    """Decode JSON messages: the event fields plus `reason`, null for good rows.

    The message is read as the only element of an array, so trailing content
    and anything but one object count as malformed.
    """
    listed = F.concat(F.lit("["), F.col(value), F.lit("]"))
    decoded = F.from_json(listed, T.ArrayType(schema), {"allowSingleQuotes": "false"})
    # The outer explode of one element decodes each message exactly once; as a plain
    # column the decoding would be repeated for every field and filter.
    staged = raw.select(*raw.columns, F.explode_outer(F.array(decoded)).alias("_events"))
    event = F.when(F.size("_events") == 1, F.get("_events", F.lit(0)))
    checks = [F.when(event.isNull(), F.lit("malformed"))]
    checks += [F.when(event[c].isNull(), F.lit(f"missing_{c}")) for c in mandatory]
    return staged.select(*raw.columns, *[event[c].alias(c) for c in schema.names], F.coalesce(*checks).alias("reason"))


def read_events(raw, schema, value="value", mandatory=()):
    """(good events, quarantined messages with their reason)"""
    parsed = parse_events(raw, schema, value, mandatory)
    good = parsed.where("reason is null").select(*schema.names)
    return good, parsed.where("reason is not null").select(value, "reason")


def page_messages(events):
    """(key, value): page events keyed by url."""
    return _messages(events, PAGE_EVENT, "url")


def chunk_messages(events):
    """(key, value): chunk events keyed by chunk_id, which spreads them evenly."""
    return _messages(events, CHUNK_EVENT, "chunk_id")


def _messages(events, schema, key):
    fields = []
    for f in schema.fields:
        column = F.col(f.name)
        if f.name == "crawled_at" and isinstance(events.schema["crawled_at"].dataType, T.TimestampType):
            column = iso_utc(column)
        fields.append(column.cast(f.dataType).alias(f.name))
    return events.select(F.col(key).alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def write_page_files(events, path):
    """Page messages as text files; files sorted by name keep each url's order.

    Range partitioning by (url, time) spreads a hot url over several files.
    """
    ordered = events.repartitionByRange("url", "crawled_at").sortWithinPartitions("url", "crawled_at")
    page_messages(ordered).select("value").write.mode("overwrite").text(path)


def write_chunk_files(events, path):
    chunk_messages(events).select("value").write.mode("overwrite").text(path)


def kafka_messages(spark, servers, topic):
    """Topic as a stream from its earliest message. Needs the Kafka connector."""
    stream = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest").load()
    )
    return stream.select(F.col("key").cast("string"), F.col("value").cast("string"))


def write_kafka(messages, servers, topic, by_key=True):
    """(key, value) rows to a topic. `by_key` keeps each key in one writing task,
    and so in order; keys that are unique need no such shuffle."""
    rows = messages.repartition("key") if by_key else messages
    (rows.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("kafka.acks", "all").option("kafka.retries", "3").option("topic", topic).save())
