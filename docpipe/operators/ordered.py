"""Row-order operators that stay balanced when one key holds most rows.

A window over a key sorts all rows of that key in one task. Here the rows are dealt
out by ranges of (key, order) first, which Spark cuts at equal row counts, whatever
the columns' types; windows run per (key, range), and a small summary per range
carries state across the cuts. The result equals that of the plain window, at any
size and by the same plan.
"""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.session import materialize


def epoch_micros(ts, data_type):
    """Microseconds since the epoch, independent of the session time zone."""
    if isinstance(data_type, T.TimestampNTZType):
        seconds = (F.unix_date(ts.cast("date")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint")
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.unix_micros(ts)


@dataclass
class Ordered:
    """Rows of `df` per `keys` in the order of `order`. `segments` is the number of
    ranges (default: the session's shuffle partitions)."""

    df: Any
    keys: list
    order: list
    segments: int | None = None

    def __post_init__(self):
        by = [*self.keys, *self.order]
        ranged = self.df.repartitionByRange(self.segments, *by) if self.segments else self.df.repartitionByRange(*by)
        # Stored: the cuts are drawn from a sample, and rows and carries must agree on them.
        self.cut = materialize(ranged.withColumn("_seg", F.spark_partition_id()), "ranges")
        self.inner = Window.partitionBy(*self.keys, "_seg").orderBy(*self.order)
        self.outer = Window.partitionBy(*self.keys).orderBy("_seg")
        self.before = self.outer.rowsBetween(Window.unboundedPreceding, -1)

    def _join_carry(self, rows, carry):
        """Attach the one carried value of each (key, segment)."""
        same = [rows[k].eqNullSafe(carry[k]) for k in [*self.keys, "_seg"]]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        return rows.join(carry, condition, "left").select(*[rows[c] for c in rows.columns], carry["_carry"])

    def previous(self, columns):
        """Add prev_<column>, the value in the row before (null in the first row)."""
        row = F.struct(*columns)
        rows = self.cut.withColumn("_prev", F.lag(row).over(self.inner))
        last = self.cut.groupBy(*self.keys, "_seg").agg(F.max_by(row, F.struct(*self.order)).alias("_last"))
        carry = (
            last.withColumn("_carry", F.lag("_last").over(self.outer))
            .where(F.col("_carry").isNotNull()).drop("_last")
        )
        joined = self._join_carry(rows, carry)
        prev = F.coalesce("_prev", "_carry")
        return joined.select(*self.df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])

    def row_number(self, name="row_number"):
        """Add the 1-based position of each row inside its key."""
        rows = self.cut.withColumn("_n", F.row_number().over(self.inner).cast("bigint"))
        sizes = self.cut.groupBy(*self.keys, "_seg").agg(F.count("*").alias("_rows"))
        carry = (
            sizes.withColumn("_carry", F.sum("_rows").over(self.before))
            .where(F.col("_carry").isNotNull()).drop("_rows")
        )
        joined = self._join_carry(rows, carry)
        return joined.select(*self.df.columns, (F.col("_n") + F.coalesce("_carry", F.lit(0))).alias(name))

    def running_sum(self, column, name="running_sum"):
        """Add the sum of `column` over the rows of the key up to this one, itself included."""
        upto = self.inner.rowsBetween(Window.unboundedPreceding, 0)
        rows = self.cut.withColumn("_n", F.sum(column).over(upto))
        sizes = self.cut.groupBy(*self.keys, "_seg").agg(F.sum(column).alias("_rows"))
        carry = (
            sizes.withColumn("_carry", F.sum("_rows").over(self.before))
            .where(F.col("_carry").isNotNull()).drop("_rows")
        )
        joined = self._join_carry(rows, carry)
        return joined.select(*self.df.columns, (F.coalesce("_n", F.lit(0)) + F.coalesce("_carry", F.lit(0))).alias(name))

    def running_max(self, column, name="running_max"):
        """Add the largest value of `column` over the rows of the key up to this one, itself included
        (nulls ignored; null while there is none)."""
        upto = self.inner.rowsBetween(Window.unboundedPreceding, 0)
        rows = self.cut.withColumn("_m", F.max(column).over(upto))
        tops = self.cut.groupBy(*self.keys, "_seg").agg(F.max(column).alias("_top"))
        carry = (
            tops.withColumn("_carry", F.max("_top").over(self.before))
            .where(F.col("_carry").isNotNull()).drop("_top")
        )
        joined = self._join_carry(rows, carry)
        return joined.select(*self.df.columns, F.greatest("_m", "_carry").alias(name))

