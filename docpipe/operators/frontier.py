"""URL frontier: sitemap rows -> pages to visit."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOC = T.StructType([T.StructField("loc", T.StringType())])


def sitemap_urls(documents, xml="xml"):
    """(sitemap, pos, url) for every <url><loc> of each sitemap document."""
    return _locations(documents, xml, "urlset", "url")


def sitemap_children(documents, xml="xml"):
    """(sitemap, pos, url) for every <sitemap><loc> of each index document."""
    return _locations(documents, xml, "sitemapindex", "sitemap")


def _locations(documents, xml, root, entry):
    found = F.xpath(F.col(xml), F.lit(f"/{root}/{entry}/loc/text()"))
    # Outer explode: an inner one would make the optimizer parse each document twice.
    entries = documents.select("sitemap", F.posexplode_outer(found).alias("pos", "url"))
    return entries.where(F.col("url").isNotNull()).select("sitemap", "pos", F.trim("url").alias("url"))


def url_filter(urls, fragment, url="url"):
    """Substring filter; an empty fragment keeps all."""
    return urls.where(F.col(url).contains(fragment)) if fragment else urls


def keep_child_sitemaps(children, fragment, url="url"):
    """Children that may hold the wanted section, or documentation in general."""
    section = fragment.split("/")[1] if "/" in fragment else fragment
    if not section:
        return children
    return children.where(F.col(url).contains(section) | F.col(url).contains("docs"))


def expand(documents, root, fragment):
    """URLs reachable from sitemap `root`, one index level deep, in document order.

    `documents` holds (sitemap, xml). The position of a url is the pair
    (position of its child sitemap, position inside it).
    """
    urls = sitemap_urls(documents)
    children = keep_child_sitemaps(sitemap_children(documents.where(F.col("sitemap") == root)), fragment)
    nested = children.select(F.col("pos").alias("child_pos"), F.col("url").alias("sitemap")).join(urls, "sitemap")
    own = urls.where(F.col("sitemap") == root).withColumn("child_pos", F.lit(-1))
    return url_filter(own.unionByName(nested), fragment).select("child_pos", "pos", "url")


def cap(urls, max_pages, order=("child_pos", "pos")):
    """The first `max_pages` urls in document order."""
    return urls.orderBy(*order).limit(max_pages)
