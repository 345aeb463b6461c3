"""Page snapshot -> extracted page rows."""

from pyspark.sql import functions as F

from docpipe.functions.html import with_title_and_text
from docpipe.functions.text import content_hash


def extract_pages(pages):
    """Replace `html` by title, text, content_hash and parse_error.

    Narrow: runs inside the scan stage, on batch and streaming input alike.
    """
    out = with_title_and_text(pages).withColumn("content_hash", content_hash(F.col("text")))
    return out.drop("html")


def nonempty(pages):
    """Pages with text; the others count as skipped."""
    return pages.where(F.col("text") != "")
