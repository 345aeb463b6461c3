"""Packing documents into fixed-length training sequences by best-fit decreasing.

A document is its token ids followed by the id 0. A document longer than a sequence
is first cut into full windows of SEQUENCE ids, each a sequence of its own; what is
left (and every shorter document) is a piece for the packer.

Pieces are dealt into packing groups by a hash of their row number and start, about
GROUP_PIECES to a group, the number of groups following the number of pieces; a hot
source or a document copied a thousand times is spread like any other. Inside a
group, pieces go in decreasing length to the open sequence with the least room that
still holds them: a segment tree over the remaining capacity 0..SEQUENCE, whose
leaves count open sequences with that much room, finds that capacity in log steps.

A sequence is padded to SEQUENCE ids, unless its fill is at most a smaller power of
two, to which it is padded instead (`padded`).

Ids are those of the tokenizers library for the given vocabulary file with
add_special_tokens=False; they are computed with tiktoken over the same ranks and
pattern (equal, and four times cheaper; tested against tokenizers), the special
string <|endoftext|> inside a text becoming its id as tokenizers makes it.

Handled cases: a null or empty text is the single id 0; a null doc_id stays null on
its pieces; repeated rows are packed as separate documents; very long texts are
encoded whole and cut into windows; an empty table gives no rows; other columns are
not carried, so their names cannot clash.
"""

import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.llm.common import store

SEQUENCE = 1024
GROUP_PIECES = 1 << 17   # pieces one best-fit run holds (bounded memory per group)
END = 0                  # id closing every document
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def default_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path):
    """text -> list of ids, equal to tokenizers' encode(text, add_special_tokens=False).ids."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    ranks_path = path[: -len(".json")] + ".tiktoken"
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    special = added.get(SPECIAL, SPECIAL_ID)
    coder = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text):
        if SPECIAL not in text:
            return coder.encode_ordinary(text)
        out = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(special)
            out.extend(coder.encode_ordinary(part))
        return out

    return encode


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
])


def pieces(docs, path=None, sequence=SEQUENCE):
    """One row per piece: doc_id, _row (row number), start, length, ids_crc32, doc_tokens."""
    path = path or default_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids_col, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = {f.name: [] for f in PIECES}
            for doc_id, text in zip(ids_col, texts, strict=True):
                ids = np.array([*encode(text or ""), END], dtype="<u4")
                for start in range(0, len(ids), sequence):
                    part = ids[start:start + sequence]
                    for name, value in zip(out, (doc_id, row, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        out[name].append(value)
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(f.name, pa.int64()) for f in PIECES]))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class CapacityTree:
    """Counts of open sequences by remaining capacity; finds the smallest capacity >= a length."""

    def __init__(self, capacity):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open = [[] for _ in range(capacity + 1)]

    def add(self, room, sequence):
        self.open[room].append(sequence)
        k = room + self.size
        while k:
            self.count[k] += 1
            k //= 2

    def take(self, length):
        """The newest open sequence with the least room >= length, removed; None if there is none."""
        count, size = self.count, self.size
        k = length + size
        if not count[k]:
            while k > 1 and not (k % 2 == 0 and count[k + 1]):
                k //= 2
            if k == 1:
                return None
            k += 1
            while k < size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - size
        sequence = self.open[room].pop()
        while k:
            count[k] -= 1
            k //= 2
        return room, sequence


def best_fit(lengths, sequence=SEQUENCE):
    """Sequence number and offset of each length (all <= sequence), best fit in decreasing order.

    Equal lengths keep their given order. Returns (sequence numbers, offsets, fills by sequence).
    """
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, fills = CapacityTree(sequence), []
    for k in order.tolist():
        n = int(lengths[k])
        found = tree.take(n) if n < sequence else None
        if found is None:
            room, s = sequence, len(fills)
            fills.append(0)
        else:
            room, s = found
        seq[k], off[k] = s, sequence - room
        fills[s] += n
        if room - n > 0:
            tree.add(room - n, s)
    return seq, off, fills


def padded_length(fill, sequence=SEQUENCE):
    size = 1
    while size < fill:
        size *= 2
    return min(size, sequence)


PACKED = T.StructType([*[f for f in PIECES if f.name != "_row"],
                       T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                       T.StructField("fill", T.LongType()), T.StructField("padded", T.LongType())])


def pack(parts, sequence=SEQUENCE, group_pieces=GROUP_PIECES):
    """Pieces (of `pieces`) with sequence_id, offset, fill and padded of their sequence.

    sequence_id = group * 2^31 + number of the sequence in its group.
    """
    groups = max(1, -(-parts.count() // group_pieces))
    keyed = parts.withColumn("_group", F.pmod(F.xxhash64("_row", "start"), F.lit(groups)))

    def place(frame):
        import pandas as pd

        frame = frame.sort_values(["_row", "start"], kind="stable").reset_index(drop=True)
        seq, off, fills = best_fit(frame["length"].to_numpy(), sequence)
        group = int(frame["_group"].iloc[0]) << 31
        fill = pd.Series(fills, dtype="int64").to_numpy()[seq]
        return frame.drop(columns=["_row", "_group"]).assign(
            sequence_id=seq + group, offset=off, fill=fill, padded=[padded_length(int(f), sequence) for f in fill])

    return keyed.groupBy("_group").applyInPandas(place, PACKED)


def packed_documents(docs, path=None, sequence=SEQUENCE, group_pieces=GROUP_PIECES):
    """The pieces of every document of `docs` (doc_id, text), placed in sequences.

    The pieces are written to the shared folder once, so that counting them for the
    number of groups does not encode the texts a second time.
    """
    return pack(store(pieces(docs, path, sequence), "pieces"), sequence, group_pieces)
