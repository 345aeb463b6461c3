"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

Sizes are word counts. Every source gets a target by weight; what a source cannot take
(its target stops at `repeats` times its size) is shared among the others by weight.
A source first takes as many complete epochs as fit in its target. The rest is a
weighted sample without replacement: each document draws an exponential key,
-ln(u) / quality weight, with u from a hash of its id and text; documents are taken in
key order until their running size is nearest to what is left.

The running size of a whole source is never sorted in one task. Keys fall into bins,
bin totals are combined on the map side, and only the documents of the one bin in
which a source's budget ends are ordered. The table of sources, one row each, is the only
thing that meets in one task (its order by code point gives the weights).

Handled cases: a null text has size 0 and is taken as 0 words; a null source is a source,
the last one; a null or non-positive quality weight counts as 1; equal keys are ordered by
doc_id and size; repeated rows are documents of their own. Reruns agree.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docpipe.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3
BINS = 4096
SEED = 17


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized, weights=WEIGHTS, share=1.0, repeats=REPEATS):
    """(source, source_size, weight, target) from (source, size).

    With the sources ordered by repeats * size / weight, those that stop at their
    limit are a prefix: source i stops if the level at which the budget left by
    the sources before it would be shared lies above its own ratio.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(repeats))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    at_limit = F.col("level") * F.col("weight") >= F.col("limit")
    levels = weighed.withColumn("level", level).withColumn("full", at_limit)
    final = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("weight"), F.col("level"))))
    shared = levels.withColumn("shared", final.over(everything)["level"])
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("shared") * F.col("weight"))
    return shared.select("source", "source_size", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def mix(sized, weights=WEIGHTS, share=1.0, repeats=REPEATS, seed=SEED, bins=BINS):
    """(doc_id, source, size, quality) -> the same with source_size, target and taken.

    `sized` is read several times; store it first.
    """
    u = (F.pmod(F.xxhash64("doc_id", "size", "mark", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    quality = F.when(F.col("quality") > 0, F.col("quality").cast("double")).otherwise(1.0)
    keyed = sized.withColumn("key", -F.log(u) / quality)
    keyed = keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins))

    targets = source_targets(sized, weights, share, repeats)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    totals = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    in_order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("bin_size").over(in_order), F.lit(0)))
    ends = (
        totals.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest")))
        .groupBy(F.col("t.source").alias("source")).agg(F.max("bin").alias("last_bin"), F.max_by("before", "bin").alias("before"))
    )
    plan = (
        targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
        .select("t.*", F.coalesce("last_bin", F.lit(bins + 1)).alias("last_bin"), "before")
    )
    # One row per source, stored: its measured size decides how Spark joins it.
    plan = materialize(plan, "plan")
    rows = keyed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.*", "p.source_size", "p.target", "p.epochs", "p.rest", "p.last_bin", "p.before")
    inside = rows.where(F.col("bin") == F.col("last_bin"))
    running = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    # The document on the border is taken if that comes nearer to the budget.
    inside = inside.withColumn("once", (F.col("rest") - start >= F.col("size") / 2) & (start < F.col("rest")))
    outside = rows.where(F.col("bin") != F.col("last_bin")).withColumn("once", (F.col("bin") < F.col("last_bin")) & (F.col("rest") > 0))
    taken = F.col("size") * (F.col("epochs") + F.col("once").cast("bigint"))
    return inside.unionByName(outside).select(
        *sized.columns, "source_size", "target", "epochs", "once", taken.cast("bigint").alias("taken"))


def sized_documents(documents, labels=None):
    """doc_id, source, size, quality, mark of every document, stored once.

    Quality weights: 2 for documents labelled good, 0.5 for bad ones, 1 without a label.
    """
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    if labels is None:
        rows = rows.withColumn("quality", F.lit(1.0))
    else:
        known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
        weight = F.when(F.col("label") == 1, 2.0).when(F.col("label") == 0, 0.5).otherwise(1.0)
        rows = rows.join(known, "doc_id", "left").select("doc_id", "source", "size", "mark", weight.alias("quality"))
    return materialize(rows, "sizes")


def mixture(documents, labels=None):
    """doc_id, size, source_size, target, taken for every document."""
    return mix(sized_documents(documents, labels)).select("doc_id", "size", "source_size", "target", "taken")
