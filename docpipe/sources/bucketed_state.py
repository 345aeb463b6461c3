"""Seen pages as a table bucketed by url, folded inside the job that keeps it.

The state is a base, stored as a Spark bucketed table (url hashed into `buckets`
files, sorted by url), plus a log of the batches since. A batch looks up its urls
by joining them, hash-partitioned into as many parts, with the base: the base is
already partitioned that way, so it is read in place and not shuffled; the log,
at most `fold_every` batches, is joined as usual. Every `fold_every` batches the job
folds base and log into a new base, so reads stay bounded however long the stream
runs. A base is written aside and renamed once complete, then registered in the
catalog by location; a restarted job registers it again, so the state survives
restarts and new sessions.

Handled cases: an empty state; a batch retried after a failure (its log entry is
written once, and folding again gives the same base).
"""

import hashlib

from pyspark.sql import functions as F

from docpipe.operators.changes import latest_seen
from docpipe.schemas import SEEN_PAGE
from docpipe.sources.state import BatchFolder


class BucketedSeen:
    """url -> content hash of the last version handed on."""

    def __init__(self, path, buckets=64, fold_every=10):
        self.path, self.buckets, self.fold_every = path.rstrip("/"), buckets, fold_every
        self.log = BatchFolder(f"{self.path}/log", SEEN_PAGE)
        self.base = BatchFolder(f"{self.path}/base", SEEN_PAGE)
        self.prefix = "seen_" + hashlib.sha1(self.path.encode()).hexdigest()[:12]

    def _table(self, spark, fold):
        name = f"{self.prefix}_{fold}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (url STRING, content_hash STRING) USING parquet "
                  f"CLUSTERED BY (url) SORTED BY (url) INTO {self.buckets} BUCKETS LOCATION '{self.path}/base/batch={fold}'")
        return spark.table(name)

    def read(self, spark, before=None, urls=None):
        """State as left by all batches before `before`: one row per url (of `urls`, if given)."""
        folds = self.base.committed(spark, before=before)
        start = folds[-1] if folds else -1
        log = self.log.read(spark, after=start, before=before).select("url", "content_hash", "batch_id")
        base = self._table(spark, start).select("url", "content_hash", F.lit(start).cast("bigint").alias("batch_id")) if folds else None
        if urls is not None:
            wanted = urls.select("url").distinct().repartition(self.buckets, "url")
            log = log.join(wanted, "url", "left_semi")
            base = base.join(wanted, "url", "left_semi") if base is not None else None
        rows = log if base is None else base.unionByName(log)
        return latest_seen(rows, "batch_id")

    def write(self, changes, batch_id):
        spark = changes.sparkSession
        self.log.write(changes, batch_id)
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(spark, batch_id)

    def fold(self, spark, batch_id):
        """Base and log up to `batch_id` as a new bucketed base (once)."""
        if self.base.committed(spark, batch_id - 1, batch_id + 1):
            return
        state = self.read(spark, before=batch_id + 1)
        aside = f"{self.path}/base/_aside-{batch_id}"
        name = f"{self.prefix}_aside_{batch_id}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        (state.repartition(self.buckets, "url").write.mode("overwrite").bucketBy(self.buckets, "url").sortBy("url")
         .option("path", aside).saveAsTable(name))
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # unmanaged: the files stay
        _, fs, jvm = self.base._fs(spark)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{self.path}/base/batch={batch_id}")):
            raise OSError(f"{aside} could not become a base")
