"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL = {}


def build_session(app="docpipe", master=None, shuffle_partitions=None, **conf):
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark, label):
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is `spark.checkpoint.dir`, else the one given to setCheckpointDir.
    Only a local session (tests, a laptop) may do without: executors of a cluster
    do not see each other's temporary folders, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _LOCAL.get(id(spark.sparkContext)) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL[id(spark.sparkContext)] = tempfile.mkdtemp(prefix="docpipe-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df, label, partition_by=()):
    """Write `df` once below the shared folder and read it back (lineage cut)."""
    path = scratch_dir(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
