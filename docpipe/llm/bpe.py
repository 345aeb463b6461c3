"""Byte-pair encoding by backtracking, and decoding by an offset table.

Aho-Corasick finds the longest vocabulary token at every position of a word. The
encoder takes the longest match, and keeps it only if the pair it forms with the
token before it is compatible: no merge of lower rank may cross their border.
Otherwise it tries the next shorter prefix token, and at last steps back. Every
position is given up at most once, so the work is linear in the word, and the
result is exactly that of applying the merges in rank order.

The end-of-word mark belongs to the last byte of a word: the alphabet is the 256
bytes and the 256 bytes that end a word. Encoded words are kept in a bounded cache
per task. Decoding gathers token strings from one byte blob through an offset
table, without a loop over tokens.

Handled cases: a null or empty text has no tokens and decodes to ''; very long
words and texts are encoded whole; repeated rows give repeated rows; columns with
the names of new ones are replaced.
"""

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.llm.common import add_columns

CACHE_WORDS = 250_000   # encoded words a task remembers before it starts afresh
CACHE_CHARS = 64        # longer words are encoded each time
PAIR_CACHE = 150_000

# Fixed value: the split of the vocabulary file, with white space spelled out.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def character_ranges(kind):
    """Inside of a character class with all code points of a general category (L, N)."""
    own = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    out, start = [], own[0]
    for last, here in zip(own, [*own[1:], None], strict=True):
        if here != last + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(last))}")
            start = here
    return "".join(out)


@lru_cache
def word_pattern():
    letter, number = character_ranges("L"), character_ranges("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")


def default_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters():
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


class TokenStrings:
    """The strings of all tokens in one blob, with a table of offsets."""

    def __init__(self, path):
        import numpy as np

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        strings = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def decode(self, ids):
        """Token strings joined by blanks, as bytes; `ids` is an integer array."""
        import numpy as np

        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[np.asarray(ids) + 1] - start
        ends = np.cumsum(length)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
        return self.blob[place][:-1].tobytes()


class Vocabulary:
    """Tables of a word BPE file: merges, longest matches, prefixes."""

    def __init__(self, path):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        form = {}
        for byte, c in byte_characters().items():
            form[ids[c]] = chr(byte)
            form[ids[c + mark]] = chr(256 + byte)
        self.parts, self.merged = {}, {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[left], ids[right], ids[left + right]
            if whole in form or whole <= max(a, b):
                raise ValueError("each token must come from one merge, in rank order")
            form[whole] = form[a] + form[b]
            self.parts[whole] = (a, b)
            self.merged[a, b] = whole
        self.length = {i: len(s) for i, s in form.items()}
        self.by_form = {s: i for s, i in zip(form.values(), form.keys(), strict=True)}
        self.shorter = {i: self._prefix(s) for i, s in form.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in form.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self._compatible = {}

    def _prefix(self, form):
        for end in range(len(form) - 1, 0, -1):
            if form[:end] in self.by_form:
                return self.by_form[form[:end]]
        return None

    def compatible(self, left, right):
        """Whether `left` and `right` may stand side by side in an encoding."""
        pair = left << 32 | right
        known = self._compatible.get(pair)
        if known is None:
            if len(self._compatible) > PAIR_CACHE:
                self._compatible.clear()
            known = self._compatible[pair] = self._check(left, right)
        return known

    def _check(self, left, right):
        # The two tokens are taken apart, latest merge first. Whenever the pieces
        # at the border could merge earlier than the merge just undone, the merge
        # order would have joined them instead.
        before = float("inf")
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < before:
                return False
            if left > right and left in self.parts:
                before, left = left, self.parts[left][1]
            elif right in self.parts:
                # of two equal ranks the left one is merged first
                before, right = right + 1, self.parts[right][0]
            elif left in self.parts:
                before, left = left, self.parts[left][1]
            else:
                return True

    def encode_form(self, word):
        """Token ids of one word in the 512-letter alphabet."""
        whole = self.by_form.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest = [None] * n
        for end, token in self.automaton.iter(word):
            longest[end - self.length[token] + 1] = token  # ends grow: the last is the longest
        open_at = bytearray(b"\x01") * (n + 1)
        out, at, token = [], 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
                continue
            token = self.shorter[token]
            while token is None:
                open_at[at] = 0
                last = out.pop()
                at -= self.length[last]
                token = self.shorter[last]
        return out


def _packed(ids):
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encodes whole texts; remembers encoded words."""

    def __init__(self, path):
        self.vocabulary = Vocabulary(path)
        self.words = word_pattern()
        self.spaces = re.compile(f"[{SPACE}]+")
        self.odd_space = re.compile(r"[\x1c-\x1f]")
        specials = sorted(self.vocabulary.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.cache = {}

    def encode(self, text):
        """The ids as little-endian unsigned 32-bit integers."""
        chunks = self.spaces.split(text) if self.odd_space.search(text) else text.split()
        cache, out = self.cache, []
        for chunk in chunks:
            coded = cache.get(chunk)
            if coded is None:
                coded = self._chunk(chunk)
                if len(chunk) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[chunk] = coded
            out.append(coded)
        return b"".join(out)

    def _chunk(self, chunk):
        if chunk.isascii() and chunk.isalpha():
            raw = chunk.lower()
            return _packed(self.vocabulary.encode_form(raw[:-1] + chr(256 + ord(raw[-1]))))
        ids = []
        for part in self.specials.split(chunk) if self.specials and "<" in chunk else (chunk,):
            special = self.vocabulary.special.get(part)
            if special is not None:
                ids.append(special)
                continue
            # Lower case goes letter by letter, so a last sigma is not a special case.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in self.words.findall(plain):
                raw = word.encode()
                ids += self.vocabulary.encode_form(raw[:-1].decode("latin-1") + chr(256 + raw[-1]))
        return _packed(ids)


@lru_cache(maxsize=2)
def codec_for(path):
    """One codec per Python worker, so that tasks share its tables."""
    return Codec(path)


@lru_cache(maxsize=2)
def strings_for(path):
    return TokenStrings(path)


def forget():
    """Drop the tables of this Python worker."""
    codec_for.cache_clear()
    strings_for.cache_clear()


def encode(df, path=None, text="text", decoded=False, keep=True):
    """`df` with ids array<int>, n_tokens long and ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) of the column `text`.

    decoded: also `decoded`, what the ids decode to, by the same Python worker.
    keep: idle workers keep the vocabulary (about 50 MB each) for their next task;
    without, they give it back, for jobs that go on with other work.
    """
    path = path or default_path()

    def make():
        import numpy as np
        import pyarrow as pa

        codec = codec_for(path)

        def run(texts):
            coded = [codec.encode(t) if t else b"" for t in texts.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32), pa.int32())
            out = [
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
            ]
            if decoded:
                strings = strings_for(path)
                out.append(pa.array([strings.decode(np.frombuffer(c, dtype="<u4")).decode() for c in coded], pa.string()))
            return out

        run.close = codec.cache.clear if keep else forget  # an idle worker holds no words
        return run

    return add_columns(df, make, [text], [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), *([T.StructField("decoded", T.StringType())] if decoded else []),
    ])


def decode(df, path=None, ids="ids"):
    """`df` with `decoded`, the text of the ids (null ids: ''). Unknown ids are an error."""
    path = path or default_path()

    def make():
        import numpy as np
        import pyarrow as pa

        strings = strings_for(path)

        def run(lists):
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([n or 0 for n in pa.compute.list_value_length(lists).to_pylist()]) if len(lists) else []
            out, at = [], 0
            for end in ends:
                out.append(strings.decode(flat[at:end]).decode())
                at = end
            return [pa.array(out, pa.string())]

        import pyarrow.compute  # noqa: F401

        return run

    return add_columns(df, make, [ids], [T.StructField("decoded", T.StringType())])


def digests(df, path=None):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    coded = encode(df.select("doc_id", "text"), path, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
