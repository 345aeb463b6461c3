from pyspark.sql import functions as F

from docpipe.operators import frontier
from docpipe.sources import sitemap

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*urls):
    return f"<?xml version='1.0'?><urlset {NS}>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


DOCS = [
    ("root", f"<sitemapindex {NS}>" + "".join(
        f"<sitemap><loc>{u}</loc></sitemap>" for u in ("s/en-docs", "s/blog", "s/guide")) + "</sitemapindex>"),
    ("s/en-docs", urlset("h/docs/concepts/b", "h/docs/tasks/x", "h/docs/concepts/a")),
    ("s/blog", urlset("h/docs/concepts/from-blog")),
    ("s/guide", urlset("h/docs/concepts/from-guide")),
    ("plain", urlset("h/docs/concepts/1", "h/other?a=1&amp;b=2", "h/docs/concepts/2")),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "sitemap string, xml string")


def ordered(df):
    return [r.url for r in df.orderBy("child_pos", "pos").collect()]


def test_index_keeps_matching_children_in_order(spark):
    out = frontier.expand(docs(spark), "root", "/docs/concepts/")
    assert ordered(out) == ["h/docs/concepts/b", "h/docs/concepts/a"]


def test_section_of_filter_selects_children(spark):
    assert ordered(frontier.expand(docs(spark), "root", "/guide/")) == []
    children = frontier.keep_child_sitemaps(frontier.sitemap_children(docs(spark)), "/guide/x")
    assert {r.url for r in children.collect()} == {"s/en-docs", "s/guide"}


def test_empty_filter_keeps_everything(spark):
    out = frontier.expand(docs(spark), "root", "")
    assert len(ordered(out)) == 5


def test_plain_sitemap_and_cap(spark):
    out = frontier.expand(docs(spark), "plain", "")
    assert ordered(out) == ["h/docs/concepts/1", "h/other?a=1&b=2", "h/docs/concepts/2"]
    assert ordered(frontier.cap(out, 2)) == ["h/docs/concepts/1", "h/other?a=1&b=2"]


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(DOCS[4][1])
    entries = sitemap.read_entries(spark, str(tmp_path / "a.xml"), "/docs/")
    assert sorted(r.url for r in entries.collect()) == ["h/docs/concepts/1", "h/docs/concepts/2"]
    whole = sitemap.read_documents(spark, str(tmp_path))
    found = frontier.sitemap_urls(whole).orderBy("pos")
    assert [r.url for r in found.collect()][1] == "h/other?a=1&b=2"
