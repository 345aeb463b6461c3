"""Table sources."""

from pyspark.sql import functions as F


def read_table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


SPREAD = "spark.docpipe.spread"


def spread(df):
    """`df`, dealt out over as many tasks as the session setting `spark.docpipe.spread` says.

    Unset (the default) nothing is moved. Meant for laptops and tests, where a table
    is a single row group and one task would do all the text work.
    """
    tasks = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(tasks)) if tasks else df


def page_snapshots(spark, folder):
    """(page_id, url, html) of a crawl."""
    return spread(read_table(spark, folder, "pages"))


def documents(spark, folder):
    return spread(read_table(spark, folder, "documents"))


def document_pages(spark, folder):
    """Documents as page events: a url per document, its text and text hash."""
    docs = documents(spark, folder)
    return docs.select(
        "doc_id", "source", "lang",
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
        "text",
        F.sha2("text", 256).alias("content_hash"),
    )
