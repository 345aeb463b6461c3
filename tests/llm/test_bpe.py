import random

import pytest
from tokenizers import Tokenizer

from docpipe.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def ids_of(codec, text):
    import numpy as np

    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


def test_odd_texts_equal_the_library(library):
    codec = bpe.codec_for(bpe.default_path())
    rng = random.Random(4)
    texts = ["", "Hello's  WORLD é a</w>b <|endoftext|>x<|startoftext|> <|EndOfText|>", "a" * 5000, "ababab" * 400, "\x1cab\x1d c d",
             "ΟΔΟΣ İstanbul ǅ ֋x", "日本語 한국어 \U0001f600‍"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), 32])) for _ in range(80)) for _ in range(300)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False)
        assert ids_of(codec, text) == want.ids, text
        import numpy as np

        assert bpe.strings_for(bpe.default_path()).decode(np.array(want.ids, dtype=np.int64)).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself(library):
    codec = bpe.codec_for(bpe.default_path())
    v = codec.vocabulary
    forms = random.Random(1).sample(sorted(v.by_form.items()), 3000)
    assert all(v.encode_form(form) == [token] for form, token in forms)


def test_cache_limit_changes_nothing(monkeypatch):
    codec = bpe.Codec(bpe.default_path())
    text = "one two three one two four five one"
    whole = codec.encode(text)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    monkeypatch.setattr(bpe, "PAIR_CACHE", 1)
    assert bpe.Codec(bpe.default_path()).encode(text) == whole


def test_frames(spark, odd_documents, no_documents, library):
    out = bpe.digests(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert [r.n_tokens for r in out if r.doc_id in (4, 5, 6)] == [0, 0, 0]
    coded = bpe.encode(odd_documents)
    assert set(coded.columns) == {*odd_documents.columns, "n_tokens", "ids_sha256"}
    for r in coded.select("text", "ids").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.digests(no_documents).count() == 0
    unknown = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert bpe.decode(unknown).first().decoded == ""


def test_a_worker_gives_its_tables_back():
    import gc
    import weakref

    held = weakref.ref(bpe.codec_for(bpe.default_path()))
    bpe.forget()
    gc.collect()
    assert held() is None and bpe.codec_for.cache_info().currsize == 0
