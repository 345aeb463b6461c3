import json
from datetime import datetime

from pyspark.sql import functions as F

from docpipe.functions.text import iso_utc
from docpipe.operators import quality, upsert
from docpipe.schemas import CHUNK_EVENT, PAGE_EVENT
from docpipe.sources import events as E

GOOD = {"url": "u", "title": "é \"q\"", "text": "line\nbreak", "crawled_at": "2024-01-01T00:00:00+00:00", "content_hash": "h"}


def raw(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_malformed_messages_are_set_apart(spark):
    bad = ["not json", "", "   ", "5", "null", "[1]", '{"url":"a"', '{"url":"a"} tail', '{"a":1} {"b":2}',
           '{"a":1},{"b":2}', "{'url':'a'}", None]
    good, dead = E.read_events(raw(spark, [json.dumps(GOOD), "{}", *bad]), PAGE_EVENT)
    got = good.orderBy(F.col("url").desc_nulls_last()).collect()
    assert [r.asDict() for r in got] == [GOOD, dict.fromkeys(GOOD)]
    assert sorted(map(str, (r.value for r in dead.collect()))) == sorted(map(str, bad))
    assert {r.reason for r in dead.collect()} == {"malformed"}


def test_mandatory_fields(spark):
    lines = ['{"chunk_id":"c","text":"t"}', '{"chunk_id":"c"}', '{"text":"t"}', '{"chunk_id":null,"text":"t"}']
    good, dead = E.read_events(raw(spark, lines), CHUNK_EVENT, mandatory=["chunk_id", "text"])
    assert sorted(r.reason for r in dead.collect()) == ["missing_chunk_id", "missing_chunk_id", "missing_text"]
    filled = quality.with_event_defaults(good, F.lit(9)).first()
    assert (filled.url, filled.title, filled.chunk_index, filled.total_chunks, filled.content_hash, filled.created_at) == (
        "", "", 0, 1, "", 9)


def test_page_message_round_trip(spark):
    pages = spark.createDataFrame([(GOOD["url"], GOOD["title"], GOOD["text"], datetime(2024, 1, 1, 0, 0, 0, 5), "h")],
                                  "url string, title string, text string, crawled_at timestamp, content_hash string")
    row = E.page_messages(pages).first()
    assert row.key == "u" and "é" in row.value
    assert json.loads(row.value) == {**GOOD, "crawled_at": "2024-01-01T00:00:00.000005+00:00"}
    good, dead = E.read_events(E.page_messages(pages), PAGE_EVENT)
    assert good.count() == 1 and dead.count() == 0


def test_times_on_the_wire_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        micros = [1706659200000005, 1710054000000000, -1]
        df = spark.createDataFrame([(m,) for m in micros], "m bigint").select("m", iso_utc(F.timestamp_micros("m")).alias("t"))
        assert {r.m: r.t for r in df.collect()} == {
            micros[0]: "2024-01-31T00:00:00.000005+00:00", micros[1]: "2024-03-10T07:00:00.000000+00:00",
            -1: "1969-12-31T23:59:59.999999+00:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_page_files_keep_the_order_of_a_hot_url(spark, tmp_path):
    pages = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), F.col("id").cast("string"))).otherwise("hot").alias("url"),
        F.lit("t").alias("title"), F.col("id").cast("string").alias("text"),
        F.timestamp_seconds(F.col("id")).alias("crawled_at"), F.lit("h").alias("content_hash")).orderBy(F.rand(1))
    E.write_page_files(pages, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    events = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    hot = [int(e["text"]) for e in events if e["url"] == "hot"]
    assert len(events) == 4000 and hot == sorted(hot)


def test_chunk_files(spark, tmp_path):
    rows = spark.createDataFrame([("c", "u", "t", 0, 1, "x", "h", 3)], CHUNK_EVENT)
    E.write_chunk_files(rows, str(tmp_path / "out"))
    good, _ = E.read_events(spark.read.text(str(tmp_path / "out")), CHUNK_EVENT, mandatory=["chunk_id", "text"])
    assert good.first() == rows.first()


def test_constraints(spark, rows):
    data = [("ok", "u", "x", [0.0, 1.0]), ("dup", "u", "x", [0.0, 1.0]), ("dup", "u", "x", [0.0, 1.0]),
            ("long", "u", "é" * 2049, [0.0, 1.0]), (None, "u", "x", [0.0, 1.0]), ("dim", "u", "x", [1.0]),
            ("k" * 65, "v" * 2049, "x", [0.0, 1.0])]
    df = spark.createDataFrame(data, "chunk_id string, url string, text string, embedding array<float>")
    got = rows(quality.constraint_violations(df, dim=2))
    assert got == sorted([("dup", "chunk_id_duplicate"), ("long", "text_too_long"), (None, "chunk_id_null"),
                          ("dim", "wrong_dimension"), ("k" * 65, "chunk_id_too_long"), ("k" * 65, "url_too_long")], key=repr)
    kept, dead = quality.quarantine(df, dim=2)
    assert kept.count() == 6 and [r.reasons for r in dead.collect()] == [["chunk_id_null"]]
    kept, dead = quality.quarantine(df, dim=2, strict=True)
    assert kept.count() == 3 and dead.count() == 4


SCHEMA = "chunk_id string, url string, content_hash string, created_at bigint, batch_id bigint"


def test_upsert_and_replacement(spark, rows):
    old = spark.createDataFrame([("a1", "a", "A", 1, 0), ("a2", "a", "A", 1, 0), ("b1", "b", "B", 1, 0)], SCHEMA)
    new = spark.createDataFrame([("a3", "a", "A'", 2, 1), ("b1", "b", "B", 2, 1), ("b1", "b", "B", 2, 1)], SCHEMA)
    assert rows(upsert.upsert(old, new).select("chunk_id", "created_at")) == [("a1", 1), ("a2", 1), ("a3", 2), ("b1", 2)]
    assert rows(upsert.replace_pages(old, new).select("chunk_id")) == [("a3",), ("b1",)]
    kept = upsert.replace_pages(old, new, keep_versions=True)
    assert kept.count() == 4
    again = upsert.replace_pages(upsert.replace_pages(old, new), new)
    assert rows(again) == rows(upsert.replace_pages(old, new))


def test_returning_content_is_current_again(spark, rows):
    old = spark.createDataFrame([("a1", "a", "A", 1, 0)], SCHEMA)
    step = upsert.replace_pages(old, spark.createDataFrame([("a2", "a", "B", 2, 1)], SCHEMA))
    back = upsert.replace_pages(step, spark.createDataFrame([("a1", "a", "A", 3, 2)], SCHEMA))
    assert rows(back.select("chunk_id")) == [("a1",)]


def test_untouched_pages_stay(spark, rows):
    current = spark.createDataFrame([("b1", "b", "B", 1, 0)], SCHEMA)
    new = spark.createDataFrame([("a1", "a", "A", 2, 1)], SCHEMA)
    assert rows(upsert.replace_pages(current, new).select("chunk_id")) == [("a1",), ("b1",)]


def test_only_one_row_per_key_is_shuffled(spark):
    df = spark.createDataFrame([("c", "u", "h", 1, 0)], SCHEMA)
    plan = upsert.newest_per_key(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_untouched_rows_pass_without_a_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from docpipe.operators import upsert

    current = spark.range(5000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"),
                                       F.concat(F.lit("u"), (F.col("id") % 500).cast("string")).alias("url"),
                                       F.lit("h").alias("content_hash"), F.lit(1).alias("created_at"), F.lit(0).alias("batch_id"))
    current.write.parquet(str(tmp_path / "current"))
    stored = spark.read.parquet(str(tmp_path / "current"))
    incoming = spark.createDataFrame([("n1", "u7", "h2", 2, 1), ("n2", "new", "h3", 2, 1)],
                                     "chunk_id string, url string, content_hash string, created_at int, batch_id int")
    maybe, surely = upsert.split_by_filter(stored, upsert.url_filter(incoming.select("url")))
    assert surely.count() + maybe.count() == 5000 and maybe.where("url = 'u7'").count() == 10
    assert surely.where("url = 'u7'").count() == 0
    assert maybe.count() < 100
    plan = surely._jdf.queryExecution().executedPlan().treeString()
    # the one exchange builds the bitmap from the incoming urls; the stored rows are not shuffled
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("_groupingexpression" in line for line in exchanges)
    merged = upsert.replace_pages(stored, incoming)
    rows = {r.chunk_id for r in merged.collect()}
    assert "n1" in rows and "n2" in rows and not any(r.startswith("c") and int(r[1:]) % 500 == 7 for r in rows) and len(rows) == 5000 - 10 + 2
