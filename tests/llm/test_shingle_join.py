import random

import pytest

from docpipe.llm import shingle_join as J


def words_of(text):
    return (text or "").encode().lower().split()


def plain(docs):
    """{doc_id: (n, component)} by comparing all pairs."""
    sets = {}
    for i, text in docs:
        w = words_of(text)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 4 * common >= 3 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_classes(df).collect()}


def edited(text, share, rng):
    return " ".join(f"x{rng.random()}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus(make_prose):
    """Near copies in a chain and around one text, a passage that many share, small texts, copies."""
    rng = random.Random(9)
    docs, base, passage = [], make_prose(1, 120), make_prose(2, 70)
    docs += [edited(base, rng.choice([0.005, 0.02, 0.04]), rng) for _ in range(70)]
    step = make_prose(3, 200)
    for _ in range(12):
        step = edited(step, 0.01, rng)
        docs.append(step)
    docs += [f"{make_prose(100 + i, 60)} {passage} {make_prose(300 + i, 60)}" for i in range(60)]
    docs += ["one two three", "one two three", "ONE two\tthree", "one two", "a b c d e", "a b c d e f", "", None, " \n"]
    docs += [base, base, base + " more"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_equals_all_pairs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(5)
    assert result(df) == plain(corpus)


def test_small_blocks_and_buckets_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 2)
    monkeypatch.setattr(J, "POSTINGS", 50)
    monkeypatch.setattr(J, "WORD_CACHE", 10)
    monkeypatch.setattr(J, "TABLES", 1)  # groups hardly form, the matrix finds the links
    df = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)
    assert result(df) == plain(corpus)


def test_the_threshold_is_exact(spark):
    """Sets of 8 words: 7 shared shingles of 9 are 0.78; 6 of 8 are exactly 3/4."""
    letters = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(letters[:11])), (2, " ".join(letters[:10] + ["z"])), (3, " ".join(letters[20:30])), (4, " ".join(letters[20:28] + ["y", "v"])),
            (5, " ".join(letters[30:37])), (6, " ".join(letters[30:36] + ["q"]))]
    assert result(spark.createDataFrame(docs, "doc_id bigint, text string")) == plain(docs)


def test_odd_rows(odd_documents, no_documents):
    rows = J.similarity_classes(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert by[2] == by[1] and by[3][1] == 1 and by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (0, 6)
    assert by[8][1] == 7 and by[10] == (1, 9)
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert J.similarity_classes(no_documents).count() == 0
