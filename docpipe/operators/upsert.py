"""Merging incoming chunk rows into a vector table without MERGE."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def newest_per_key(rows, key="chunk_id", order=("created_at",)):
    """One row per key, the newest. The rank filter also runs before the shuffle,
    so a key with many copies sends at most one row per map task."""
    best = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def upsert(current, incoming, key="chunk_id", order=("created_at", "batch_id")):
    """Rows of both inputs, the newest per key."""
    return newest_per_key(current.unionByName(incoming), key, order)


def drop_stale(rows, version=("created_at", "batch_id")):
    """Keep only the chunks of each url's newest content.

    The newest hash per url is found from a few narrow columns, combined on the
    map side; the join back splits skewed urls at run time.
    """
    newest = rows.groupBy("url").agg(
        F.max_by("content_hash", F.struct(*version, "content_hash")).alias("content_hash")
    )
    return rows.join(newest, ["url", "content_hash"], "left_semi")


FILTER_BITS = 1 << 24  # bits of the url filter: at most FILTER_BITS / 64 broadcast rows, whatever the batch


def _slot(column):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def url_filter(urls):
    """(_word, _bits): a bitmap of the hashed urls, combined on the map side; fixed size."""
    return urls.select(_slot("url").alias("_s")).groupBy(F.floor(F.col("_s") / 64).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_s % 64 as int))")).alias("_bits"))


def split_by_filter(rows, bits):
    """(maybe, surely_not): rows whose url may be in the bitmap, and those that cannot be."""
    slot = _slot("url")
    held = rows.withColumn("_s", slot).join(F.broadcast(bits), F.floor(F.col("_s") / 64) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_s % 64 as int)) & 1L) = 1"), F.lit(False))
    flagged = held.withColumn("_hit", hit).drop("_s", "_word", "_bits")
    return flagged.where("_hit").drop("_hit"), flagged.where("not _hit").drop("_hit")


def replace_pages(current, incoming, key="chunk_id", order=("created_at", "batch_id"), keep_versions=False):
    """Upsert, then remove chunks of superseded page content unless kept on purpose.

    `current` has one row per key, and a key belongs to one url. Only rows whose
    url comes in again are merged; the others pass through. A bitmap of the
    incoming urls' hashes, of fixed size and broadcast, sets the stored rows that
    cannot belong to an incoming url apart before any join: they pass without a
    shuffle, so the bytes shuffled follow the batch (and the bitmap's false hits),
    not the table.
    """
    urls = incoming.select("url").distinct()
    maybe, untouched_for_sure = split_by_filter(current, url_filter(urls))
    untouched = untouched_for_sure.unionByName(maybe.join(urls, "url", "left_anti"))
    both = maybe.join(urls, "url", "left_semi").unionByName(incoming)
    # The newest content of a url is the same before and after merging its chunks,
    # so stale rows leave before the shuffle by key.
    live = both if keep_versions else drop_stale(both, order)
    return untouched.unionByName(newest_per_key(live, key, order))
