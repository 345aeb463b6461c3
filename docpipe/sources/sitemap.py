"""Sitemap files.

`read_entries` streams the <url> entries of very large files; `read_documents`
loads each file as one row, which keeps document order and index files.
"""

from pyspark.sql import functions as F


def read_entries(spark, path, fragment=""):
    """(url,) for each <url><loc> containing `fragment`, order not kept."""
    entries = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    urls = entries.select(F.trim("loc").alias("url")).where("url is not null")
    return urls.where(F.col("url").contains(fragment)) if fragment else urls


def read_documents(spark, path):
    """(sitemap, xml): one row per file; the protocol bounds a file to 50 MB."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("sitemap"), F.col("value").alias("xml"))
