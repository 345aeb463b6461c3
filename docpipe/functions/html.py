"""Title and body text of a web page.

Measured on the test pages, this small tag-stack reader is about twice as fast per
core as the equivalent chain of regular-expression columns, and it also reads nested
or unclosed elements correctly. Pages are long rows: a plain UDF takes them in
batches of 100, where an Arrow batch would bring 10,000 into a worker's memory.
"""

from functools import cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are not content, and where content is looked for.
CHROME = ["nav", "header", "footer", "aside", "script", "style"]
ROOTS = ["main", "article", "body"]

_PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("failed", T.BooleanType()),
])


def with_title_and_text(df, html="html", url="url"):
    """Add `title`, `text` and `parse_error`; all null where there is no html."""
    # Marked non-deterministic so that filters on the result are not pushed below
    # it, where the optimizer would parse every page a second time.
    page = df.withColumn("_page", read_page.asNondeterministic()(F.col(html), F.col(url)))
    return page.select(
        *df.columns,
        F.col("_page.title").alias("title"),
        F.col("_page.text").alias("text"),
        F.col("_page.failed").alias("parse_error"),
    )


@F.udf(_PAGE, useArrow=False)
def read_page(html, url):
    return _reader()(html, url)


@cache
def _reader():
    """(html, url) -> (title, text, failed), made once per Python worker."""
    from collections import Counter
    from html.entities import html5
    from html.parser import HTMLParser

    void = set("area base br col embed hr img input link meta param source track wbr".split())
    hidden = set(CHROME) | {"template", "rt", "rp"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.open = []
            self.depth = Counter()  # open elements per tag
            self.hidden = 0      # how many open elements hide their content
            self.run = []        # text since the last mark
            self.title = None
            self.found = {}      # root tag -> its text pieces
            self.active = {}     # slot -> stack depth of the element that fills it

        def flush(self):
            if self.run and not self.hidden:
                text = "".join(self.run)
                for slot in self.active:
                    if slot == "title":
                        self.title.append(text.strip())
                    else:
                        self.found[slot].append(text)
            self.run = []

        def handle_data(self, data):
            self.run.append(data)

        def handle_entityref(self, name):
            # Names count with or without the semicolon; unknown ones stay text.
            self.run.append(html5.get(name + ";") or html5.get(name) or "&" + name)

        def handle_charref(self, name):
            try:
                number = int(name[1:], 16) if name[0] in "xX" else int(name)
                # Numbers below 256 are read in the Windows code page, as browsers do.
                char = bytes([number]).decode("cp1252", "ignore") if number < 256 else ""
                self.run.append(char or chr(number))
            except (ValueError, OverflowError):
                self.run.append("\ufffd")

        def handle_comment(self, data):
            self.flush()

        handle_decl = handle_pi = handle_comment

        def unknown_decl(self, data):
            self.flush()
            if data.upper().startswith("CDATA["):
                self.run.append(data[6:])
                self.flush()

        def handle_starttag(self, tag, attrs):
            self.flush()
            if tag in void:
                return
            self.open.append(tag)
            self.depth[tag] += 1
            self.hidden += tag in hidden
            if self.hidden:
                return
            if tag == "title" and self.title is None:
                self.title = []
                self.active["title"] = len(self.open)
            if tag in ROOTS and tag not in self.found:
                self.found[tag] = []
                self.active[tag] = len(self.open)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in void:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            self.flush()
            if not self.depth[tag]:
                return
            while True:
                last = self.open.pop()
                self.depth[last] -= 1
                self.hidden -= last in hidden
                if last == tag:
                    break
            self.active = {s: d for s, d in self.active.items() if d <= len(self.open)}

    def read(markup, address):
        if markup is None:
            return None, None, None
        try:
            reader = Reader()
            reader.feed(markup)
            reader.close()
            reader.flush()
        except Exception:
            return None, None, True
        title = address if reader.title is None else "".join(reader.title)
        pieces = next((reader.found[t] for t in ROOTS if t in reader.found), [])
        return title, " ".join(" ".join(pieces).split()), False

    return read
