"""A vector table stored by cell and kept current by a stream.

Each micro-batch rewrites only the cells it touches, by dynamic partition overwrite:
the cells of its rows, and the cells that hold older rows of its urls (a page whose
content changed may move to other cells). Those cells are read through a broadcast
join on the partition column (at most as many rows as the index has cells), so
dynamic partition pruning leaves the other cells unread; their new content keeps,
per url, the rows of the newest version, stored or incoming. The content is staged
in the shared folder first, so the write does not read the path it replaces.

Every touched cell gets one tombstone row (null key), so a cell whose rows all left is
replaced by an empty one; reads drop tombstones. A batch run again after a failure
computes the same content from whatever state the failure left, so a retry is
harmless. Rename-based partition replacement is atomic per cell on file systems with
atomic renames (HDFS, local), not on object stores.

Handled cases: equal versions of a url keep the incoming rows; repeated keys in a
batch keep one row; an empty batch touches nothing.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docpipe.session import materialize


class CellTable:
    """Rows (key, url, version, cell, ...) below `path`, partitioned by cell; `url` names the
    column whose rows are replaced together (a page)."""

    def __init__(self, path, schema, key="chunk_id", url="url"):
        self.path, self.schema, self.key, self.url = path, schema, key, url

    def _stored(self, spark):
        try:
            return spark.read.schema(self.schema).parquet(self.path)
        except Exception as missing:  # noqa: BLE001 - no batch has been written yet
            if "PATH_NOT_FOUND" not in str(missing) and "does not exist" not in str(missing):
                raise
            return spark.createDataFrame([], self.schema)

    def read(self, spark):
        return self._stored(spark).where(F.col(self.key).isNotNull())

    def apply(self, batch, batch_id=None):
        spark = batch.sparkSession
        columns = [f.name for f in self.schema]
        incoming = batch.select(*columns)
        # one row per key in the batch: the newest version
        by_key = Window.partitionBy(self.key).orderBy(F.col("version").desc(), F.col("cell"))
        incoming = incoming.withColumn("_n", F.row_number().over(by_key)).where("_n = 1").drop("_n")
        incoming = materialize(incoming.withColumn("_in", F.lit(1)), "incoming")
        if incoming.isEmpty():
            return
        stored = self.read(spark)
        urls = incoming.select(self.url).distinct()
        cell_type = self.schema["cell"].dataType
        touched = materialize(
            stored.join(urls, self.url, "left_semi").select("cell").unionByName(incoming.select("cell")).distinct()
            .select(F.col("cell").cast(cell_type)), "touched")
        inside = stored.join(F.broadcast(touched), "cell").select(*columns).withColumn("_in", F.lit(0))
        both = inside.unionByName(incoming)
        newest = Window.partitionBy(self.url)
        top = F.max(F.struct("version", "_in")).over(newest)
        kept = both.withColumn("_top", top).where(F.col(self.url).isNull() | (F.struct("version", "_in") == F.col("_top"))).drop("_in", "_top")
        tombstones = touched.select(*[F.col(c) if c == "cell" else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in columns])
        staged = materialize(kept.unionByName(tombstones), "cells")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(self.path)


def cell_table_query(rows, table, checkpoint, once=True, seconds=2):
    """A stream of vector rows (with cell) -> `table`, one rewrite of touched cells per batch."""
    writer = rows.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()
