import re
from collections import defaultdict

import pytest

from docpipe.llm import mixing


def plain_targets(sizes, repeats=3):
    """Water filling, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-6 and open_:
        share, total = left, sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s] / total
            over = target[s] - repeats * sizes[s]
            if over >= 0:
                target[s], left = float(repeats * sizes[s]), left + over
                open_.discard(s)
    return target


def check(rows):
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"] and r["size"] * (r.taken // r["size"] if r["size"] else 0) == r.taken
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-3)
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert all(r.source_size == sizes[r.source] for r in rows)


@pytest.mark.parametrize("bins", [1, 8, 4096])
def test_takes_what_the_targets_say(spark, bins):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sized = mixing.sized_documents(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = mixing.mix(sized, bins=bins).collect()
    assert len(rows) == docs.count()
    check(rows)
    assert sorted(map(str, mixing.mix(sized, bins=bins).collect())) == sorted(map(str, rows))


def test_skewed_sources(spark):
    data = [(i, "w " * (i % 7 + 1), "hot") for i in range(300)] + [(1000, "w", "tiny"), (1001, None, None), (1002, "w w", None)]
    check(mixing.mix(mixing.sized_documents(spark.createDataFrame(data, "doc_id bigint, text string, source string"))).collect())


def test_odd_rows(spark, odd_documents, no_documents):
    rows = mixing.mix(mixing.sized_documents(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    check(rows)
    for r in odd_documents.select("doc_id", "text").collect():
        assert {x["size"] for x in rows if x.doc_id == r.doc_id} >= {len(re.findall(mixing.WORD, r.text or ""))}
    assert mixing.mixture(no_documents).count() == 0


def test_better_documents_come_first(spark):
    from pyspark.sql import functions as F

    sized = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"), F.lit(10).cast("bigint").alias("size"),
        F.when(F.col("id") % 2 == 0, 4.0).otherwise(0.5).alias("quality"), F.lit(0).cast("bigint").alias("mark"))
    kept = mixing.mix(sized).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    n = {r.odd: r.n for r in kept}
    assert n[0] > 2 * n[1] > 0
