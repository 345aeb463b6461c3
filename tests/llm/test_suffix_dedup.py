import hashlib
import random

import numpy as np
import pytest

from docpipe.llm import suffix_dedup as D
from docpipe.llm.suffix_array import maximal_repeats, suffix_array


def test_suffix_array_and_maximal_repeats():
    rng = random.Random(5)
    for t in range(120):
        s = np.array([rng.randrange(3) for _ in range(rng.randrange(0, 50))], dtype=np.int64)
        n = len(s)
        if t % 3 == 0 and n:
            s[rng.randrange(n)] = 99
        order, lcp = suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        strings = {}
        for i in range(n):
            for j in range(i + 2, n + 1):
                strings.setdefault(tuple(s[i:j].tolist()), []).append(i)
        want = set()
        for w, places in strings.items():
            left = {s[i - 1] if i else -1 - i for i in places}
            right = {s[i + len(w)] if i + len(w) < n else -1 - i for i in places}
            if len(places) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(w), tuple(places)))
        assert {(k, tuple(sorted(p.tolist()))) for k, p in maximal_repeats(s, 2)} == want


def plain(docs):
    first, out = {}, {}
    for i, text in docs:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            key = raw[k:k + 50]
            first[key] = min(first.get(key, i), i)
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for k in range(len(raw) - 49):
            if first[raw[k:k + 50]] < i:
                gone[k:k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.remove_repeats(df).collect()}


@pytest.fixture(scope="module")
def corpus(make_prose):
    rng = random.Random(3)
    passage, line = make_prose(1, 40), "a line that ends up in many of the texts, é, again"
    docs = []
    for i in range(60):
        parts = [make_prose(10 + i, rng.randrange(5, 80))]
        if i % 2:
            parts.insert(rng.randrange(2), passage)
        if i % 3 == 0:
            parts.append(line)
        if i % 7 == 0:
            parts.append(passage[rng.randrange(20):rng.randrange(60, 120)])
        docs.append(rng.choice([" ", "\n", ""]).join(parts))
    docs += [docs[0], docs[1], docs[5][10:], "a" * 500, "b" + "a" * 300, "ab" * 200, "a" * 49, "a" * 50, "", None, passage[:50], passage[3:53], passage[:49]]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_equals_all_strings(spark, corpus):
    assert result(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)) == plain(corpus)


def test_limits_change_nothing(spark, corpus, monkeypatch):
    """Every limit of a task in use: flushes, buffers, parts of long texts, many contexts, small arrays."""
    for name, value in (("CHUNK", 128), ("FLUSH_BYTES", 2000), ("CONTEXTS", 2), ("SUFFIX_BYTES", 300), ("BUCKET_BYTES", 5000)):
        monkeypatch.setattr(D, name, value)
    assert result(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(2)) == plain(corpus)


def test_long_text_in_parts(make_prose, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 256)
    text = make_prose(4, 3000)
    whole, cut = D._Batch(), D._Batch()
    whole.add(1, 0, text)
    cut.add(1, 0, text)
    parts = cut.anchors()
    monkeypatch.setattr(D, "CHUNK", 1 << 20)
    rows = whole.anchors()
    assert sorted(set(map(str, parts.tolist()))) == sorted(set(map(str, rows.tolist())))


def test_odd_rows(odd_documents, no_documents):
    rows = D.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].n_removed == by[2].n_bytes and by[1].n_removed == 0 and by[8].n_removed == by[8].n_bytes
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert D.remove_repeats(no_documents).count() == 0


def test_buckets_are_settled_in_shares(spark, corpus, monkeypatch):
    """A bucket larger than SETTLE_BYTES gives the same spans, settled in shares of at most about that size."""
    monkeypatch.setattr(D, "SETTLE_BYTES", 1000)
    assert result(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)) == plain(corpus)


def test_a_share_holds_all_entries_of_its_hashes():
    import numpy as np

    rng = np.random.default_rng(2)
    code, doc = rng.integers(0, 300, 2000).astype("<u4"), np.sort(rng.integers(0, 50, 2000))
    ids, marks, pos = np.arange(50) * 3, np.arange(50) * 7, np.arange(2000, dtype="<i4")
    blob = D._pack(ids, marks, [code, pos, doc])
    shares = [D._unpack(blob, ("<u4", "<i4"), k, 5) for k in range(5)]
    assert all((s[2] % 5 == k).all() for k, s in enumerate(shares))
    assert sorted(np.concatenate([s[3] for s in shares]).tolist()) == pos.tolist()
    assert all((s[0] == ids[doc[s[3]]]).all() and (s[1] == marks[doc[s[3]]]).all() and (s[2] == code[s[3]]).all() for s in shares)
