import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docpipe.functions.tokens import tokenizer
from docpipe.operators import chunks


def windows_by_loop(words, size, overlap):
    out, start = [], 0
    while start < len(words):
        end = min(start + size, len(words))
        out.append(words[start:end])
        if end == len(words):
            break
        start += size - overlap
    return out


def cut(spark, texts, size, overlap, tok=None):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = chunks.token_windows(df, "text", size, overlap, tok).orderBy("i", "chunk_index").collect()
    return [[r for r in rows if r.i == i] for i in range(len(texts))]


@pytest.mark.parametrize("size,overlap", [(10, 3), (5, 0), (2, 1)])
def test_edges(spark, size, overlap):
    stride = size - overlap
    counts = [0, 1, size - 1, size, size + 1, size + stride - 1, size + stride, size + stride + 1, 3 * size + 1]
    words = [[f"w{j}" for j in range(n)] for n in counts]
    got = cut(spark, ["  ".join(w) + "\n" for w in words], size, overlap)
    for w, rows in zip(words, got):
        want = windows_by_loop(w, size, overlap)
        assert [r.text for r in rows] == [" ".join(x) for x in want]
        assert [r.chunk_index for r in rows] == list(range(len(want)))
        assert all(r.total_chunks == len(want) for r in rows)
        assert [r.n_tokens for r in rows] == [len(x) for x in want]


def test_null_text_gives_no_rows(spark):
    df = spark.createDataFrame([(1, None)], "i int, text string")
    assert chunks.token_windows(df, "text", 10, 2).count() == 0


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunks.token_windows(spark.createDataFrame([(1, "a")], "i int, text string"), "text", 8, 8)


def test_neighbours_share_exactly_the_overlap(spark):
    (rows,) = cut(spark, [" ".join(map(str, range(1000)))], 64, 8)
    for a, b in zip(rows, rows[1:]):
        assert a.text.split()[-8:] == b.text.split()[:8]
    covered = [w for r in rows for w in r.text.split()[8 if r.chunk_index else 0:]]
    assert covered == [str(i) for i in range(1000)]


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(max_size=200).filter(lambda t: "\x00" not in t), min_size=20, max_size=40))
def test_white_space_agrees_with_python(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = cut(spark, texts, 7, 2)
    assert [[r.text for r in rows] for rows in got] == [
        [" ".join(w) for w in windows_by_loop(t.split(), 7, 2)] for t in texts]


def test_pretokens_are_lossless(spark):
    texts = ["Don't stop,  now!\n\n12345 é x", " lead and trail \t", "日本語 text..."]
    got = cut(spark, texts, 1000, 10, tokenizer("pretoken"))
    assert [rows[0].text for rows in got] == texts


@pytest.fixture
def rank_file(tmp_path):
    pieces = [bytes([b]) for b in range(256)] + [b"th", b"the", b"an", b"and"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" " + str(i).encode() for i, p in enumerate(pieces)))
    return str(path)


def test_bpe_windows(spark, rank_file):
    text = "the and the é <|endoftext|>"
    (rows,) = cut(spark, [text], 4, 1, tokenizer("bpe", rank_file))
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from docpipe.functions.text import PRETOKEN

    codec = tiktoken.Encoding("t", pat_str=PRETOKEN, mergeable_ranks=load_tiktoken_bpe(rank_file), special_tokens={})
    ids = codec.encode(text, disallowed_special=())
    assert [r.text for r in rows] == [codec.decode(w) for w in windows_by_loop(ids, 4, 1)]
    assert sum(r.n_tokens for r in rows) - (len(rows) - 1) == len(ids)


def test_tokenizer_choice(rank_file):
    with pytest.raises(ValueError):
        tokenizer("bpe")
    with pytest.raises(ValueError):
        tokenizer("other")


def test_rows_fill_missing_fields_and_repeat_their_ids(spark):
    pages = spark.createDataFrame([("u", None, "a b c", "h"), (None, "t", "x", None)],
                                  "url string, title string, text string, content_hash string")
    first = chunks.chunk_rows(pages, 2, 1, created_at=F.lit(7)).orderBy("url", "chunk_index").collect()
    again = chunks.chunk_rows(pages, 2, 1, created_at=F.lit(9)).orderBy("url", "chunk_index").collect()
    assert [(r.url, r.title, r.chunk_index, r.total_chunks, r.text, r.content_hash, r.created_at) for r in first] == [
        ("", "t", 0, 1, "x", "", 7), ("u", "", 0, 2, "a b", "h", 7), ("u", "", 1, 2, "b c", "h", 7)]
    assert [r.chunk_id for r in first] == [r.chunk_id for r in again]
    assert len({r.chunk_id for r in first}) == 3 and all(len(r.chunk_id) == 64 for r in first)


def test_plan_tokenizes_once_and_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a b")], "i int, text string")
    plan = chunks.token_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "Exchange" not in plan


def test_token_count(spark):
    df = spark.createDataFrame([("a b  c",)], "text string")
    assert df.select(chunks.token_count(F.col("text"))).first()[0] == 3
