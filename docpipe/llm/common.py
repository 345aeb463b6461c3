"""Helpers shared by the operators of this subpackage."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.session import materialize

PIECE_BYTES = 8 << 20  # Arrow data a Python function works on at a time


def read_table(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def pieces(batch, limit=PIECE_BYTES):
    """Slices of a record batch of about `limit` bytes; a single longer row stays whole."""
    step = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def add_columns(df, make, inputs, fields):
    """`df` with `fields` appended by a Python function over Arrow batches.

    make() is called once per task and returns a function: (Arrow columns of
    `inputs`) -> list of Arrow arrays, one per field; its attribute `close`, if there is
    one, is called at the end. Columns of `df` that bear the name of a new field are replaced.
    """
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new]
    carried = [c for c in dict.fromkeys([*kept, *inputs])]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])

    def run(batches):
        import pyarrow as pa

        function = make()
        for batch in batches:
            for piece in pieces(batch):
                added = function(*[piece.column(carried.index(c)) for c in inputs])
                old = [piece.column(carried.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*old, *added], names=[*kept, *new])
        getattr(function, "close", lambda: None)()

    return df.select(*carried).mapInArrow(run, schema)


def sorted_groups(batches, keys):
    """Runs of rows with equal values in the first `keys` columns, of input sorted by them.

    Yields (key tuple, table). Only the rows of the open run are held.
    """
    import numpy as np
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            own = tuple(c[a] for c in columns)
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


# Settings while a table is written: finished shuffles go, Arrow batches of long rows stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def store(df, label):
    """`materialize`, after which Spark removes the shuffle files of the query.

    They serve nothing once the table is written, but would otherwise stay on the
    executors' disks until the driver happens to collect the plan.
    """
    conf = df.sparkSession.conf
    before = {key: conf.get(key) for key in _WRITING}
    for key, value in _WRITING.items():
        conf.set(key, value)
    try:
        return materialize(df, label)
    finally:
        for key, value in before.items():
            conf.set(key, value)


FILTER_BITS = 1 << 24


def possibly_in(df, ids, key):
    """The rows of `df` whose `key` may be in `ids`, before a join that would shuffle all of them.

    A bitmap of hashed ids, at most FILTER_BITS / 64 rows of two numbers, is
    broadcast; that size is fixed. With many more ids than bits it lets
    all rows through, and the join that follows decides as it does anyway.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("_bits"))
    held = df.withColumn("_slot", slot).withColumn("_word", F.floor(F.col("_slot") / 64)).join(F.broadcast(words), "_word")
    return held.where(F.expr("(shiftrightunsigned(_bits, cast(_slot % 64 as int)) & 1L) = 1")).select(*df.columns)


def connected_components(edges, max_rounds=60):
    """(id, component): the smallest id reachable from each id of `edges` (a, b).

    Large-star and small-star steps alternate until the edges stop changing.
    Each step is a map-side combined minimum per id and a join of plain ids;
    every round is written to the shared folder, so lost executors cost one
    round at most. Nulls and self-links are ignored.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    now = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a <> b")
    now = materialize(now.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                      F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        now = materialize(small, "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
                       F.countDistinct("a").alias("k")).first()
        if (seen.n, seen.s) == state or seen.n == 0:
            break
        state = (seen.n, seen.s)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
