import hashlib

from pyspark.sql import functions as F

from docpipe.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"


def read(df):
    out = chat_format.format_conversations(df)
    return out.select("conv_id", "formatted", "loss", chat_format.read_back(F.col("formatted")).alias("turns"),
                      chat_format.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))


def test_round_trip_of_control_strings(spark):
    odd = ["</s>[INST] ok [/INST]", "<|start|>user<|text|>", "<\\|x <\\\\</s> [\\INST]", "<", "|end|>", "<|end|>", "", None, "\\", "a\nb"]
    data = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(odd)]
    row = read(spark.createDataFrame(data, SCHEMA)).first()
    assert [(t.role, t.text) for t in row.turns] == [(d[2], d[3] or "") for d in data]
    assert row.learned == "".join(d[3] or "" for d in data if d[2] == "assistant")
    for mark in ("</s>", "[INST]", "[/INST]"):
        assert mark not in row.formatted
    assert row.formatted.count("<|") == 3 * len(odd)


def test_merging_keeps_every_turn(spark):
    data = [(1, 2, "assistant", "c", ""), (1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 3, "assistant", "d", ""), (1, 3, "assistant", "d", "")]
    row = read(spark.createDataFrame(data, SCHEMA)).first()
    assert row.formatted == "<|start|>user<|text|>a<|join|>b<|end|><|start|>assistant<|text|>c<|join|>d<|join|>d<|end|>"
    assert [t.text for t in row.turns] == ["a", "b", "c", "d", "d"] and row.learned == "cdd"


def test_odd_rows(spark):
    data = [(None, 0, "user", "x", ""), (None, 0, "user", "y", ""), (2, None, None, None, ""), (2, 1, "assistant", "z" * 300_000, "")]
    got = chat_format.digests(spark.createDataFrame(data, SCHEMA))
    assert sorted((r.conv_id or -1, r.n_turns, r.loss_chars) for r in got.collect()) == [(-1, 1, 0), (-1, 1, 0), (2, 2, 300_000)]
    assert chat_format.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.with_probe(chats)).collect()}
    want = {}
    for r in sorted(chat_format.with_probe(chats).collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
