from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.operators import embed, search
from docpipe.operators.chunks import chunk_rows
from docpipe.operators.extract import extract_pages, nonempty
from docpipe.schemas import PAGE_EVENT
from docpipe.sources.state import BatchFolder, SeenPages, VectorTable
from docpipe.streaming import jobs

T0 = datetime(2024, 1, 1)


def snapshots(spark, path, crawl, pages):
    data = [(u, f"<title>{u}</title><body>{b}</body>", T0 + timedelta(hours=crawl, seconds=i)) for i, (u, b) in enumerate(pages)]
    spark.createDataFrame(data, jobs.SNAPSHOT).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def site(tmp_path):
    class Site:
        raw, pages, chunks, vectors, dead = (str(tmp_path / n) for n in ("raw", "pages", "chunks", "vectors", "dead"))
        seen = SeenPages(str(tmp_path / "seen"))
        table = VectorTable(vectors)
        embedder = embed.HashEmbedder(32)

        def run(self, spark, max_files=None):
            """All three stages to the end of their input."""
            jobs.change_query(jobs.snapshot_stream(spark, self.raw, max_files), self.pages, self.seen,
                              str(tmp_path / "c1")).awaitTermination()
            pages = BatchFolder(self.pages, jobs.PAGE_TABLE).stream(spark)
            jobs.chunk_query(pages, self.chunks, str(tmp_path / "c2"), 4, 1).awaitTermination()
            chunks = BatchFolder(self.chunks, jobs.CHUNK_TABLE).stream(spark)
            jobs.vector_query(chunks, self.table, self.embedder, str(tmp_path / "c3"), dead_path=self.dead).awaitTermination()

        def emitted(self, spark):
            return [(r.batch_id, r.url, r.text) for r in BatchFolder(self.pages, jobs.PAGE_TABLE).read(spark)
                    .orderBy("batch_id", "url", "crawled_at").collect()]

    return Site()


def stored(spark, site):
    return sorted((r.url, r.chunk_index, r.text) for r in site.table.read(spark).collect())


def test_stages_restart_and_replace(spark, site):
    snapshots(spark, site.raw, 0, [("a", "one two three four five"), ("b", "stay"), ("c", "")])
    site.run(spark)
    assert site.emitted(spark) == [(0, "a", "one two three four five"), (0, "b", "stay")]
    assert stored(spark, site) == [("a", 0, "one two three four"), ("a", 1, "four five"), ("b", 0, "stay")]

    site.run(spark)  # nothing new
    assert len(site.emitted(spark)) == 2

    snapshots(spark, site.raw, 1, [("a", "new text"), ("b", "stay"), ("d", "first")])
    site.run(spark)  # continues from the checkpoints
    assert site.emitted(spark)[2:] == [(1, "a", "new text"), (1, "d", "first")]
    assert stored(spark, site) == [("a", 0, "new text"), ("b", 0, "stay"), ("d", 0, "first")]

    site.seen.compact(spark)
    site.table.compact(spark)
    assert stored(spark, site) == [("a", 0, "new text"), ("b", 0, "stay"), ("d", 0, "first")]

    snapshots(spark, site.raw, 2, [("a", "one two three four five"), ("b", "stay")])
    site.run(spark)  # a page may return to earlier content
    assert site.emitted(spark)[4:] == [(2, "a", "one two three four five")]
    assert stored(spark, site) == [("a", 0, "one two three four"), ("a", 1, "four five"), ("b", 0, "stay"), ("d", 0, "first")]
    state = {r.url: r.content_hash for r in site.seen.read(spark).collect()}
    assert set(state) == {"a", "b", "d"}


def test_versions_inside_one_batch(spark, site):
    snapshots(spark, site.raw, 0, [("a", "A"), ("a", "B"), ("a", "A"), ("a", "A")])
    site.run(spark)
    assert [t for _, _, t in site.emitted(spark)] == ["A", "B", "A"]
    assert stored(spark, site) == [("a", 0, "A")]


def test_stream_equals_batch(spark, site, rows):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        "url", "html", F.timestamp_seconds(F.col("page_id")).alias("crawled_at"))
    pages.repartition(5).write.parquet(site.raw)
    site.run(spark, max_files=2)
    assert len(BatchFolder(site.pages, jobs.PAGE_TABLE).committed(spark)) > 1
    batch = chunk_rows(nonempty(extract_pages(pages)), 4, 1)
    columns = ["chunk_id", "url", "title", "chunk_index", "total_chunks", "text", "content_hash"]
    assert rows(site.table.read(spark).select(*columns)) == rows(batch.select(*columns))

    asked = site.embedder.transform(spark.createDataFrame([(1, "the of and")], "query_id int, text string"))
    assert search.exact_search(site.table.read(spark), asked.select("query_id", "embedding")).count() == 5


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    folder = BatchFolder(str(tmp_path / "f"), PAGE_EVENT)
    df = spark.createDataFrame([("u", "t", "x", "now", "h")], PAGE_EVENT)
    folder.write(df, 0)
    folder.write(df.unionByName(df), 0)
    assert folder.read(spark).count() == 1
    (tmp_path / "f" / "batch=1").mkdir()          # an attempt that never finished
    assert folder.committed(spark) == [0] and folder.read(spark).count() == 1
    folder.write(df, 1)
    assert folder.read(spark, after=0).count() == 1 and folder.read(spark, before=1).count() == 1


def test_state_reads_ignore_the_running_batch(spark, tmp_path):
    seen = SeenPages(str(tmp_path / "s"))
    seen.write(spark.createDataFrame([("u", "A")], "url string, content_hash string"), 0)
    seen.write(spark.createDataFrame([("u", "B")], "url string, content_hash string"), 1)
    assert seen.read(spark, before=1).first().content_hash == "A"
    assert seen.read(spark).first().content_hash == "B"
    assert seen.read(spark, urls=spark.createDataFrame([("x",)], "url string")).count() == 0


def test_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"url":"u","text":"t"}\nnot json\n{"url":"w"}\n')
    raw = spark.readStream.text(str(tmp_path / "in"))
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    jobs.event_query(raw, PAGE_EVENT, good, dead, str(tmp_path / "cp"), mandatory=["text"]).awaitTermination()
    assert [r.url for r in BatchFolder(good, PAGE_EVENT).read(spark).collect()] == ["u"]
    assert sorted(r.reason for r in spark.read.parquet(dead).collect()) == ["malformed", "missing_text"]


def run_to_memory(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_redelivery_is_dropped(spark, tmp_path):
    schema = "url string, content_hash string, crawled_at timestamp"
    data = [("a", "A", T0), ("a", "A", T0 + timedelta(minutes=5)), ("a", "B", T0), ("b", "A", T0)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    run_to_memory(jobs.without_redelivery(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "dedup")
    assert spark.table("dedup").count() == 3


def test_closed_windows(spark):
    path = "/root/testdata/sf0.01"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    run_to_memory(jobs.stage_counts(stream, "1 day"), "closed")
    got = sorted((r.start, r.event_type, r.n) for r in spark.table("closed").collect())
    events = spark.read.parquet(f"{path}/events.parquet")
    mark = events.agg(F.max("ts")).first()[0] - timedelta(hours=24)
    days = events.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").count().collect()
    assert got == sorted((r.start, r.event_type, r["count"]) for r in days if r.start + timedelta(days=1) <= mark)


def test_offsets_from_progress():
    progress = {"sources": [{"endOffset": {"t": {"0": 4, "1": 9}}, "latestOffset": '{"t": {"0": 10, "1": 9, "2": 3}}'}]}
    assert jobs.offset_rows(progress) == [("t", 0, 4, 10), ("t", 1, 9, 9), ("t", 2, 0, 3)]


def test_incomplete_batches_are_not_streamed(spark, tmp_path):
    from pyspark.sql import types as T

    from docpipe.sources.state import BatchFolder

    folder = BatchFolder(str(tmp_path / "t"), T.StructType([T.StructField("x", T.LongType())]))
    folder.write(spark.range(3).withColumnRenamed("id", "x"), 0)
    spark.range(100, 105).withColumnRenamed("id", "x").write.parquet(f"{folder.path}/_aside-1")
    assert folder.committed(spark) == [0]
    out = str(tmp_path / "out")
    (folder.stream(spark).writeStream.format("parquet").option("checkpointLocation", f"{out}-c")
     .trigger(availableNow=True).start(out).awaitTermination())
    assert sorted(r.x for r in spark.read.schema(folder.schema).parquet(out).collect()) == [0, 1, 2]
