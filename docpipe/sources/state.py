"""Versioned tables: the pages already seen and the chunk vectors.

A table is a folder with one sub-folder per batch; Spark's _SUCCESS file marks a
batch as complete. A batch writes only its own changes; `compact` folds what has
gathered into a base version, which later reads start from.
"""

from pyspark.sql import types as T

from docpipe.operators.changes import latest_seen
from docpipe.operators.upsert import replace_pages
from docpipe.schemas import CHUNK_VECTOR, SEEN_PAGE


class BatchFolder:
    """Parquet batches `<path>/batch=<id>`, each written at most once."""

    def __init__(self, path, schema):
        self.path = path.rstrip("/")
        self.schema = schema

    def _fs(self, spark):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def committed(self, spark, after=-1, before=None):
        """Ids of complete batches in (after, before), ascending."""
        root, fs, jvm = self._fs(spark)
        if not fs.exists(root):
            return []
        names = [entry.getPath().getName() for entry in fs.listStatus(root)]
        ids = sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("batch="))
        wanted = [i for i in ids if i > after and (before is None or i < before)]
        return [i for i in wanted if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={i}/_SUCCESS"))]

    def write(self, df, batch_id, partition_by=()):
        """Write one batch; a batch already complete (a retry) is left as it is.

        It is written aside and renamed once complete, so that neither reads nor
        streams see part of a batch.
        """
        spark = df.sparkSession
        if self.committed(spark, batch_id - 1, batch_id + 1):
            return
        aside, done = f"{self.path}/_aside-{batch_id}", f"{self.path}/batch={batch_id}"
        df.select(*self.schema.names).write.mode("overwrite").partitionBy(*partition_by).parquet(aside)
        _, fs, jvm = self._fs(spark)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(done)):
            raise OSError(f"{aside} could not become {done}")

    def read(self, spark, after=-1, before=None):
        """Rows of the complete batches in (after, before), with their batch_id."""
        ids = self.committed(spark, after, before)
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not ids:
            rows = spark.createDataFrame([], schema)
        else:
            rows = spark.read.schema(schema).option("basePath", self.path).parquet(
                *[f"{self.path}/batch={i}" for i in ids])
        return rows.withColumnRenamed("batch", "batch_id")

    def stream(self, spark, max_files=None):
        """The complete batches as an unbounded input, oldest first."""
        root, fs, _ = self._fs(spark)
        fs.mkdirs(root)
        reader = spark.readStream.schema(self.schema).option("recursiveFileLookup", "true")
        if max_files:
            reader = reader.option("maxFilesPerTrigger", str(max_files))
        return reader.parquet(self.path)


class SeenPages:
    """url -> content hash of the last version handed on."""

    def __init__(self, path):
        self.log = BatchFolder(f"{path}/log", SEEN_PAGE)
        self.base = BatchFolder(f"{path}/base", SEEN_PAGE)

    def read(self, spark, before=None, urls=None):
        """State as left by all batches before `before`: one row per url.

        With `urls` only their state is looked up, so that a small batch joins a
        scan instead of aggregating the whole log.
        """
        bases = self.base.committed(spark, before=before)
        start = bases[-1] if bases else -1
        log = self.log.read(spark, after=start, before=before)
        rows = self.base.read(spark, after=start - 1, before=start + 1).unionByName(log) if bases else log
        if urls is not None:
            rows = rows.join(urls.distinct(), "url", "left_semi")
        return latest_seen(rows, "batch_id")

    def write(self, changes, batch_id):
        self.log.write(changes, batch_id)

    def compact(self, spark):
        """Fold the log so far into a new base."""
        done = self.log.committed(spark)
        if done:
            self.base.write(self.read(spark), done[-1])


class VectorTable:
    """Chunk vectors. Reads give the newest content of every url."""

    def __init__(self, path, with_cells=True):
        fields = [*CHUNK_VECTOR.fields, T.StructField("version", T.LongType())]
        if with_cells:
            fields.append(T.StructField("cell", T.IntegerType()))
        self.schema = T.StructType(fields)
        self.partition_by = ["cell"] if with_cells else []
        self.delta = BatchFolder(f"{path}/delta", self.schema)
        self.base = BatchFolder(f"{path}/base", self.schema)

    def write(self, rows, batch_id):
        """Append one batch of chunk rows; visible to the next read."""
        self.delta.write(rows, batch_id)

    def read(self, spark, keep_versions=False):
        bases = self.base.committed(spark)
        start = bases[-1] if bases else -1
        fresh = self.delta.committed(spark, after=start)
        base = self.base.read(spark, after=start - 1, before=start + 1) if bases else None
        if not fresh and base is not None:
            return base.drop("batch_id")  # straight scan, partition pruning by cell
        delta = self.delta.read(spark, after=start)
        current = delta.limit(0) if base is None else base
        merged = replace_pages(current, delta, order=("version", "batch_id"), keep_versions=keep_versions)
        return merged.drop("batch_id")

    def compact(self, spark):
        """Write the merged table, partitioned by cell, as the new base.

        Rebalancing puts each cell into few files and splits cells that are larger
        than the rest, so no task writes an uneven share.
        """
        done = self.delta.committed(spark)
        if done and done[-1] not in self.base.committed(spark):
            rows = self.read(spark)
            if self.partition_by:
                rows = rows.hint("rebalance", *self.partition_by)
            self.base.write(rows, done[-1], self.partition_by)
