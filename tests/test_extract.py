import hashlib

import pytest
from pyspark.sql import functions as F

from docpipe.operators.extract import extract_pages, nonempty

CASES = {
    "no_title": ("<html><body><p>Hi</p></body></html>", "no_title", "Hi"),
    "empty_title": ("<title></title><body>x</body>", "", "x"),
    "title_trimmed": ("<title>\n A &amp; B </title><body>x</body>", "A & B", "x"),
    "main_wins": ("<body><article>a</article><main>m</main></body>", "main_wins", "m"),
    "article_over_body": ("<body>b<article>a <i>c</i></article></body>", "article_over_body", "a c"),
    "no_root": ("<title>t</title><p>loose</p>", "t", ""),
    "chrome": ("<body><nav>n</nav><header>h</header>a<aside>s</aside><script>var x='<p>';</script>b"
               "<style>p{}</style><footer>f</footer></body>", "chrome", "a b"),
    "comment": ("<body>a<!-- <nav> -->b</body>", "comment", "a b"),
    "nested_nav": ("<body><nav>x<nav>y</nav>z</nav>kept</body>", "nested_nav", "kept"),
    "unclosed_nav": ("<body><div><nav>x</div>kept</body>", "unclosed_nav", "kept"),
    "nested_article": ("<article>a<article>b</article>c</article>d", "nested_article", "a b c"),
    "unicode_space": ("<body>a  b&nbsp;c　</body>", "unicode_space", "a b c"),
    "references": ("<body>&lt;b&gt; &#233; &#x41; &eacute; &amp;lt;</body>", "references", "<b> é A é &lt;"),
    "loose_references": ("<body>a&amp b &copy, &bogus c &#150; &#x1F600;</body>", "loose_references", "a& b ©, &bogus c – 😀"),
    "cdata": ("<body>a<![CDATA[x]]>b</body>", "cdata", "a x b"),
    "one_node": ("<body>a&amp;b<i>c</i>d</body>", "one_node", "a&b c d"),
    "gt_in_attribute": ('<body><a title="x>y">t</a></body>', "gt_in_attribute", "t"),
    "bare_lt": ("<body>1 < 2 <b>ok</b></body>", "bare_lt", "1 < 2 ok"),
    "void": ("<body>a<br>b<br/>c</body>", "void", "a b c"),
    "title_in_nav": ("<nav><title>no</title></nav><body>x</body>", "title_in_nav", "x"),
}


@pytest.fixture(scope="module")
def extracted(spark):
    pages = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("missing", None)], "url string, html string")
    return {r.url: r for r in extract_pages(pages).collect()}


@pytest.mark.parametrize("name", CASES)
def test_title_and_text(extracted, name):
    _, title, text = CASES[name]
    row = extracted[name]
    assert (row.title, row.text, row.parse_error) == (title, text, False)
    assert row.content_hash == hashlib.sha256(text.encode()).hexdigest()


def test_missing_html_is_no_page(extracted):
    row = extracted["missing"]
    assert row.parse_error is None and row.text is None and row.content_hash is None


def test_filter_does_not_parse_twice(spark):
    pages = spark.createDataFrame([("u", "<body>x</body>")], "url string, html string")
    plan = nonempty(extract_pages(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("read_page(") == 1
    assert nonempty(extract_pages(pages)).count() == 1


def test_unclosed_tags_stay_linear(spark):
    import time

    page = "<body>" + "<p>x" * 40_000 + "</i>" * 40_000 + "</body>"
    pages = spark.createDataFrame([("u", page)], "url string, html string")
    started = time.time()
    assert extract_pages(pages).first().text == " ".join("x" * 40_000)
    assert time.time() - started < 15


def test_pages_pass_in_small_batches(spark):
    pages = spark.createDataFrame([("u", "<body>x</body>")], "url string, html string")
    plan = extract_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
