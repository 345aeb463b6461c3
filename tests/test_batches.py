import datetime as dt
import random

from docpipe.operators import batches


def plain(rows, size, timeout):
    """Batches by walking each topic's rows in order."""
    out = []
    topics = sorted({r[0] for r in rows if r[1] is not None}, key=lambda t: (t is not None, t))
    for topic in topics:
        own = sorted((r for r in rows if r[0] == topic and r[1] is not None), key=lambda r: (r[1], r[2]))
        i, no = 0, 0
        while i < len(own):
            j = i + 1
            while j < len(own) and j - i < size and own[j][1] < own[i][1] + timeout:
                j += 1
            closed = "size" if j - i == size else "end" if j == len(own) else "timeout"
            out.append((topic, no, own[i][2], j - i, closed))
            i, no = j, no + 1
    return sorted(out, key=repr)


def test_equals_a_walk_with_a_hot_topic(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(3000):
        topic = "hot" if k % 3 else rng.choice(["a", "b", None])
        ts = None if k % 97 == 0 else start + dt.timedelta(seconds=rng.randrange(0, 4000) / 4)
        rows.append((topic, ts, k))
    rows += [("tie", start, 5000 + k) for k in range(70)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "topic string, ts timestamp, id long, n int").repartition(5)
    for size, seconds in ((32, 2), (4, 60), (1000, 0.25)):
        got = batches.timeout_batches(df, "topic", "ts", "id", size, int(seconds * 1e6), segments=7)
        have = sorted(((r.topic, r.batch_no, r.first_id, r.n, r.closed_by) for r in got.collect()), key=repr)
        assert have == plain(rows, size, dt.timedelta(seconds=seconds))


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "topic string, ts timestamp, id long")
    assert batches.timeout_batches(df, "topic", "ts", "id").count() == 0
    one = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1)], "topic string, ts timestamp, id long")
    assert [tuple(r)[1:] for r in batches.timeout_batches(one, "topic", "ts", "id").select("topic", "batch_no", "n", "closed_by").collect()] == [(0, 1, "end")]
