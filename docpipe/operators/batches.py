"""Count-or-timeout batches replayed over event time, without walking a topic in one task.

A consumer closes its batch when it holds `size` rows, or when `timeout` has passed
since the batch's first row: a row arriving at or after first + timeout opens the
next batch. Replayed over the rows of a topic in (ts, id) order, a batch starting at
row i ends before

    next(i) = min(i + size, first row j with ts_j >= ts_i + timeout, end of topic).

The batches are the orbit of the first row under next. All rows get one global
index by (topic, ts, id) through range cuts (a hot topic spans many cuts); the row
past each deadline is found by merging deadlines into that same order (a deadline
sorts before rows of equal time, and deadlines keep the order of their rows, so the
number of rows before it is its merged position minus its own index). The orbit of
row 0 comes from pointer doubling: jumps of 2^k batches by self-joins, then, from
the largest jump down, each set of starts gains the starts half a jump after it.
The end of a topic is the start of the next one, so one orbit covers all topics.

Handled cases: rows with null ts are not batched; a null topic is a topic; equal
times are ordered by id; an empty table gives no rows.
"""

from pyspark.sql import functions as F

from docpipe.operators.ordered import Ordered, epoch_micros
from docpipe.session import materialize


def _position(df, order, name, segments=None):
    """0-based position of each row of `df` in the order `order`, over all rows."""
    return Ordered(df, [], order, segments).row_number(name).withColumn(name, F.col(name) - 1)


def batch_starts(nxt, total):
    """Starts on the path 0 -> nxt(0) -> ... below `total`, from a table (i, nxt) by pointer doubling."""
    spark = nxt.sparkSession
    jumps = [materialize(nxt.unionByName(spark.range(total, total + 1).select(F.col("id").alias("i"), F.col("id").alias("nxt"))), "jump")]
    reach = 1
    while reach < total:
        j = jumps[-1]
        doubled = j.alias("a").join(j.alias("b"), F.col("a.nxt") == F.col("b.i")).select(F.col("a.i"), F.col("b.nxt"))
        jumps.append(materialize(doubled, "jump"))
        reach *= 2
    starts = spark.range(0, min(1, total)).select(F.col("id").alias("i"))
    for j in reversed(jumps[:-1]):
        after = starts.join(j, "i").select(F.col("nxt").alias("i")).where(F.col("i") < total)
        starts = materialize(starts.unionByName(after).distinct(), "starts")
    return starts


def timeout_batches(rows, topic, ts, id_, size=32, timeout_us=2_000_000, segments=None):
    """(topic, batch_no, first_id, first_ts, n, closed_by) of count-or-timeout batches.

    batch_no counts from 0 per topic; closed_by is 'size', 'timeout' or 'end' (the
    topic's last batch, drained).
    """
    base = rows.where(F.col(ts).isNotNull()).select(F.col(topic).alias("_t"), F.col(ts).alias("_ts"), F.col(id_).alias("_id"))
    base = base.withColumn("_us", epoch_micros(F.col("_ts"), rows.schema[ts].dataType))
    indexed = _position(base, ["_t", "_us", "_id"], "i", segments)
    # rows after i in its topic, i included: the topic ends at i + left
    left = Ordered(indexed, ["_t"], [F.col("_us").desc(), F.col("_id").desc()], segments).row_number("left")
    indexed = materialize(left, "indexed")
    total = indexed.count()
    data = indexed.select("_t", F.col("_us").alias("_k"), F.lit(1).alias("_kind"), "i")
    probes = indexed.select("_t", (F.col("_us") + F.lit(timeout_us)).alias("_k"), F.lit(0).alias("_kind"), "i")
    merged = _position(data.unionByName(probes), ["_t", "_k", "_kind", "i"], "_g", segments)
    deadline = merged.where("_kind = 0").select("i", (F.col("_g") - F.col("i")).alias("j"))
    steps = materialize(indexed.join(deadline, "i").select(
        "i", "_t", "_ts", "_id", (F.col("i") + F.col("left")).alias("end"),
        F.least(F.col("i") + F.lit(size), "j", F.col("i") + F.col("left")).alias("nxt")), "steps")
    starts = batch_starts(steps.select("i", "nxt"), total)
    batches = steps.join(starts, "i").select(
        "i", F.col("_t"), F.col("_id").alias("first_id"), F.col("_ts").alias("first_ts"), (F.col("nxt") - F.col("i")).alias("n"),
        F.when(F.col("nxt") - F.col("i") == size, "size").when(F.col("nxt") == F.col("end"), "end").otherwise("timeout").alias("closed_by"))
    numbered = Ordered(batches, ["_t"], ["i"], segments).row_number("batch_no")
    return numbered.select(F.col("_t").alias(topic), (F.col("batch_no") - 1).alias("batch_no"), "first_id", "first_ts", "n", "closed_by")
