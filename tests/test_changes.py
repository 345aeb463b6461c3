import pytest
from pyspark.sql import functions as F

from docpipe.operators import changes

SEEN = [("u1", "A"), ("u2", "X"), ("u4", "Q")]


def frames(spark, data):
    pages = spark.createDataFrame(data, "url string, seq int, content_hash string")
    return pages, spark.createDataFrame(SEEN, "url string, content_hash string")


@pytest.mark.parametrize("segments", [1, 4, None])
def test_versions_inside_one_run(spark, rows, segments):
    pages, seen = frames(spark, [("u1", 1, "A"), ("u1", 2, "B"), ("u1", 3, "A"), ("u2", 1, "X"), ("u3", 1, "Z"), ("u3", 2, "Z")])
    got = changes.page_versions(pages, seen, ["seq"], segments)
    assert rows(got) == [("u1", 2, "B"), ("u1", 3, "A"), ("u3", 1, "Z")]


def test_copies_and_whole_rows(spark, rows):
    data = [("u1", 1, "A", "a"), ("u1", 2, "B", "b"), ("u1", 2, "B", "b"), ("u1", 3, "A", "a"), ("u3", None, "Z", "z")]
    pages = spark.createDataFrame(data, "url string, seq int, content_hash string, text string")
    seen = spark.createDataFrame(SEEN, "url string, content_hash string")
    got = changes.page_versions(pages, seen, ["seq"])
    assert rows(got) == sorted([("u1", 2, "B", "b"), ("u1", 3, "A", "a"), ("u3", None, "Z", "z")], key=repr)


def test_changed_and_unchanged_split_the_pages(spark, rows):
    pages, seen = frames(spark, [("u1", 1, "A"), ("u2", 1, "Y"), ("u3", 1, "Z")])
    assert rows(changes.changed_pages(pages, seen).select("url")) == [("u2",), ("u3",)]
    assert rows(changes.unchanged_pages(pages, seen).select("url")) == [("u1",)]


def test_second_crawl_emits_nothing(spark):
    pages, _ = frames(spark, [("u1", 1, "A"), ("u2", 1, "Y")])
    assert changes.changed_pages(pages, pages.select("url", "content_hash")).count() == 0


def test_latest_seen(spark, rows):
    log = spark.createDataFrame([("u", "A", 1), ("u", "B", 3), ("u", "A", 2), ("w", "Z", 1)],
                                "url string, content_hash string, version int")
    assert rows(changes.latest_seen(log)) == [("u", "B"), ("w", "Z")]


def test_outcomes_and_report(spark, rows):
    pages = spark.createDataFrame(
        [("u1", "t", "A", False), ("u2", "", "E", False), ("u3", None, None, True), ("u4", None, None, None), ("u5", "n", "N", False)],
        "url string, text string, content_hash string, parse_error boolean")
    _, seen = frames(spark, [("x", 1, "x")])
    out = changes.crawl_outcomes(pages, seen)
    assert rows(out.select("url", "outcome")) == [
        ("u1", "unchanged"), ("u2", "empty"), ("u3", "parse_error"), ("u4", "fetch_error"), ("u5", "emitted")]
    assert changes.crawl_report(out).first().asDict() == {
        "urls_found": 5, "crawled": 4, "emitted": 1, "skipped": 2, "errored_fetch": 1, "errored_parse": 1}


def test_failed_and_empty_pages_are_never_emitted(spark, rows):
    pages = spark.createDataFrame(
        [("u1", None, None), ("u2", "", "E"), ("u4", "n", "N")], "url string, text string, content_hash string")
    _, seen = frames(spark, [("x", 1, "x")])
    assert rows(changes.changed_pages(pages, seen).select("url")) == [("u4",)]
    outcomes = changes.crawl_outcomes(pages.withColumn("parse_error", F.when(F.col("text").isNotNull(), F.lit(False))), seen)
    assert rows(outcomes.where("outcome = 'emitted'").select("url")) == [("u4",)]


def test_observed_counters_equal_the_report_in_one_pass(spark, tmp_path):
    from docpipe.operators import changes as C

    outcomes = spark.createDataFrame(
        [(f"u{k}", o) for k, o in enumerate(["emitted", "emitted", "empty", "unchanged", "fetch_error", "parse_error", "emitted"])],
        "url string, outcome string")
    written = []

    def write(df):
        df.write.parquet(str(tmp_path / "out"))
        written.append(df.columns)

    counters = C.observed_report(outcomes, write)
    report = C.crawl_report(outcomes).first().asDict()
    assert {k: int(v) for k, v in counters.items()} == {k: int(v) for k, v in report.items()}
    assert written == [["url"]] and spark.read.parquet(str(tmp_path / "out")).count() == 3
