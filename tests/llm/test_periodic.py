import random
import zlib

import numpy as np

from docpipe.llm import periodic


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randrange(0, 260)
        words = [rng.randrange(rng.choice([1, 2, 3, 6, 40])) for _ in range(n)]
        if n > 20 and rng.random() < 0.7:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 2 + 1))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        tile = rng.choice([1, 2, 8, 64, 4096])
        assert periodic.runs_of(words, tile=tile) == periodic.brute_force_runs(words)


def test_long_and_degenerate():
    assert periodic.runs_of(np.zeros(30000, int)) == [(0, 30000, 1)]
    loop = list(range(37)) * 400
    assert periodic.runs_of(loop) == [(0, len(loop), 37)]
    assert periodic.runs_of(list(range(11)) + [0] * 11) == []
    assert periodic.runs_of([]) == [] and periodic.runs_of([4]) == []


def test_planted_tail():
    doc_id = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    words = [f"w{k}" for k in range(300)]
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % 300
    p = 1 + (300 - a) // (3 + g % 8)
    out = periodic.perturbed(words, doc_id)
    assert out[:a] == words[:a] and all(out[i] == words[a + (i - a) % p] for i in range(a, 300))
    assert periodic.perturbed(words, None) == words


def test_odd_documents(spark, odd_documents, no_documents, make_prose):
    loop = " ".join(["a b c"] * 10)
    extra = spark.createDataFrame([(90, loop), (91, "x " * 30), (92, make_prose(9, 3000))], "doc_id bigint, text string")
    docs = odd_documents.select("doc_id", "text", "n_chars", "score").unionByName(extra, allowMissingColumns=True)
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        words = periodic.perturbed(periodic.WORD.findall(r.text or ""), r.doc_id)
        _, ids = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (None, [])
        want = periodic.brute_force_runs(ids) if len(words) < 4000 else periodic.runs_of(ids)
        assert r.n_runs == len(want)
        if want:
            s, length, p = min(want, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, length, p, 1000 * length // p)
        else:
            assert r.start is None and r.length is None
    by_id = {r.doc_id: r for r in got if r.doc_id in (90, 91)}
    assert (by_id[90].start, by_id[90].length, by_id[90].period) == (0, 30, 3)
    assert by_id[90].collapsed_sha256 == __import__("hashlib").sha256(b"a b c").hexdigest()
    assert periodic.periodic_runs(no_documents).count() == 0
