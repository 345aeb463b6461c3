"""Change detection against the pages already seen."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from docpipe.operators.ordered import Ordered


def latest_seen(log, order="version"):
    """Current state of an append-only (url, content_hash, version) log.

    Combined on the map side, so a url with many versions stays cheap.
    """
    return log.groupBy("url").agg(F.max_by("content_hash", order).alias("content_hash"))


def with_seen_hash(pages, seen):
    """Add `seen_hash` (null where the url was never stored).

    A plain equi-join: skewed urls on the page side are split at run time, since
    `seen` has one row per url.
    """
    state = seen.select("url", F.col("content_hash").alias("seen_hash"))
    return pages.join(state, "url", "left")


def with_content(pages):
    """Pages that were fetched and read, and are not empty: the only ones that are compared."""
    read = pages.where(F.col("content_hash").isNotNull())
    return read.where("text <> ''") if "text" in pages.columns else read


def changed_pages(pages, seen):
    """Pages with content whose url is new or whose stored hash differs."""
    return (
        with_seen_hash(with_content(pages), seen)
        .where(~F.col("content_hash").eqNullSafe(F.col("seen_hash")))
        .drop("seen_hash")
    )


def unchanged_pages(pages, seen):
    """Pages with content whose stored hash is the same."""
    return with_content(pages).join(seen.select("url", "content_hash"), ["url", "content_hash"], "left_semi")


def page_versions(pages, seen, order, segments=None):
    """Changes inside one run: each row is compared with the version before it,
    the first one with the stored hash. A url that goes A, B, A emits each step.

    The comparison runs on keys and hashes alone, copies of one version collapsed
    on the map side; whole rows are fetched for the changes. `pages` is scanned
    twice, so it should be a stored or persisted table.
    """
    keys = ["url", *order]
    keys += [c for c in ["content_hash"] if c not in keys]
    versions = pages.select(*keys).distinct()
    ordered = Ordered(versions, ["url"], list(order), segments).previous(["content_hash"])
    known = with_seen_hash(ordered, seen)
    before = F.coalesce("prev_content_hash", "seen_hash")
    changed = known.where(~F.col("content_hash").eqNullSafe(before)).select(*keys)
    if set(pages.columns) == set(keys):
        return changed.select(*pages.columns)
    same = reduce(and_, [pages[k].eqNullSafe(changed[k]) for k in keys])
    return pages.join(changed, same, "left_semi").dropDuplicates(keys)


def crawl_outcomes(pages, seen):
    """Label every extracted page: fetch_error, parse_error, empty, unchanged, emitted."""
    known = with_seen_hash(pages, seen)
    outcome = (
        F.when(F.col("parse_error").isNull(), "fetch_error")
        .when(F.col("parse_error"), "parse_error")
        .when(F.col("text") == "", "empty")
        .when(F.col("content_hash").eqNullSafe(F.col("seen_hash")), "unchanged")
        .otherwise("emitted")
    )
    return known.withColumn("outcome", outcome).drop("seen_hash")


def _counters():
    o = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("urls_found"),
        F.count_if(o != "fetch_error").alias("crawled"),
        F.count_if(o == "emitted").alias("emitted"),
        F.count_if(o.isin("empty", "unchanged")).alias("skipped"),
        F.count_if(o == "fetch_error").alias("errored_fetch"),
        F.count_if(o == "parse_error").alias("errored_parse"),
    ]


def observed_report(outcomes, write):
    """The run counters of `crawl_report`, gathered while `write` stores the emitted pages.

    The counters are observed on the rows as they stream to the writer, before the
    filter that keeps emitted pages, so the run is read once. `write` takes a DataFrame
    and runs one action on it; the counters are a dict, available once it returns.
    """
    from pyspark.sql import Observation

    seen = Observation("crawl")
    watched = outcomes.observe(seen, *_counters())
    write(watched.where(F.col("outcome") == "emitted").drop("outcome"))
    return seen.get


def crawl_report(outcomes):
    """The run counters, in one row."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count("*").alias("urls_found"),
        F.count_if(o != "fetch_error").alias("crawled"),
        F.count_if(o == "emitted").alias("emitted"),
        F.count_if(o.isin("empty", "unchanged")).alias("skipped"),
        F.count_if(o == "fetch_error").alias("errored_fetch"),
        F.count_if(o == "parse_error").alias("errored_parse"),
    )
