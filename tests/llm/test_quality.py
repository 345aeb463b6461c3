import random

import numpy as np

from docpipe.llm import quality


def test_pairs_in_linear_time():
    """The sum-of-squares identity against the plain sum over pairs."""
    rng = np.random.default_rng(1)
    m = quality.Machine(20, 0, 3)
    m.weights, m.factors, m.bias = rng.normal(size=20), rng.normal(size=(20, 3)), 0.3
    index, x = np.array([1, 5, 7, 19]), rng.normal(size=4)
    want = m.bias + m.weights[index] @ x + sum(
        m.factors[index[i]] @ m.factors[index[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(m.margin(index, x)[0] - want) < 1e-12


def test_learns_an_interaction():
    """Exclusive or of two words has no linear solution."""
    features, rng, rows = quality.Features(), random.Random(2), []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["left" if a else "right", "up" if b else "down"]
        rows.append((features(" ".join(words)), int(a != b)))
    machine = quality.train(rows[:1200], 1 << quality.BITS, epochs=20)
    assert np.mean([(machine.probability(f) > 0.5) == y for f, y in rows[1200:]]) > 0.95


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.graded(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all((r.score >= 0.3) == r.predicted for r in got)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.graded(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.graded(odd_documents, labels.where("1 = 0")).collect() if r.doc_id == 4} != set()
    assert quality.graded(no_documents, labels).count() == 0
    scored = quality.score(odd_documents, quality.train([], 1 << quality.BITS))
    assert scored.columns.count("score") == 1


def test_a_repeated_document_is_learned_once(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(quality, "train", lambda examples, *a, **b: learned.append(examples))
    docs = [(1, "a hot text"), (2, "another text"), (3, None)]
    hot = [(1, f"text number {i}") for i in range(50)] + [(1, "a hot text")] * 50
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    for rows in (docs + hot, (hot + docs)[::-1]):
        quality.fit(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), labels, sample=3)
    assert [len(x) for x in learned] == [3, 3] and [y for _, y in learned[0]] == [1, 0, 1]
    assert all(np.array_equal(a, b) for x, y in zip(*learned) for a, b in zip(x[0], y[0]))
