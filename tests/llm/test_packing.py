import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from docpipe.llm import packing


def test_ids_equal_the_library():
    library = Tokenizer.from_file(packing.default_path())
    encode = packing.encoder(packing.default_path())
    rng = random.Random(2)
    texts = ["", "a<|endoftext|>b <|endoftext|><|endoftext|>", "  Hello's  WORLD\n\n\té", "日本語 한국어 \U0001f600‍", "x" * 20000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), 32, 10])) for _ in range(200)) for _ in range(200)]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, text


def plain_best_fit(lengths, size):
    """Best fit decreasing by scanning every open sequence."""
    rooms, where = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fits = [s for s, room in enumerate(rooms) if room >= n and n < size]
        if fits:
            s = min(fits, key=lambda s: rooms[s])
        else:
            s = len(rooms)
            rooms.append(size)
        where[k] = (s, size - rooms[s])
        rooms[s] -= n
    return where, rooms


def test_best_fit_equals_a_scan():
    rng = random.Random(5)
    for size in (1, 7, 64, 1024):
        lengths = [rng.randrange(1, size + 1) for _ in range(700)]
        seq, off, fills = packing.best_fit(lengths, size)
        where, rooms = plain_best_fit(lengths, size)
        assert len(fills) == len(rooms)
        assert sorted(fills, reverse=True) == sorted((size - r for r in rooms), reverse=True)
        used = {}
        for k, n in enumerate(lengths):
            used.setdefault(int(seq[k]), []).append((int(off[k]), n))
        for parts in used.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert parts[0][0] == 0 and sum(n for _, n in parts) <= size


def test_odd_documents(spark, odd_documents, no_documents):
    got = packing.packed_documents(odd_documents, group_pieces=5).toPandas()
    library = Tokenizer.from_file(packing.default_path())
    rows = odd_documents.select("doc_id", "text").collect()
    assert got.groupby("doc_id", dropna=False).size().sum() == len(got)
    pieces = []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for start in range(0, len(ids), 1024):
            part = ids[start:start + 1024]
            pieces.append((r.doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
    have = [tuple(x) for x in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(object).where(got.notna(), None).values.tolist()]
    key = lambda t: tuple((v is None, v) for v in t)
    assert sorted(have, key=key) == sorted(pieces, key=key)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset.values == np.cumsum(seq.length.values) - seq.length.values).all()
        assert seq.length.sum() <= 1024 and (seq.fill == seq.length.sum()).all()
    assert packing.packed_documents(no_documents).count() == 0


def test_padding():
    assert [packing.padded_length(f) for f in (1, 2, 3, 500, 513, 1024)] == [1, 2, 4, 512, 1024, 1024]
