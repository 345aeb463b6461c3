"""Tokenizers: text column -> token array, and token array -> text.

whitespace  words, joined by blanks (default)
pretoken    lossless pieces of the cl100k split pattern
bpe         integer tokens of a rank file the caller supplies
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.functions.text import PRETOKEN, SPACE


class Whitespace:
    name = "whitespace"

    def encode(self, text):
        return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")

    def decode(self, tokens):
        return F.array_join(tokens, " ")


class Pretoken:
    name = "pretoken"

    def encode(self, text):
        return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))

    def decode(self, tokens):
        return F.array_join(tokens, "")


class Bpe:
    """Byte-pair tokens. `rank_file` must be readable on every executor.

    Special-token text counts as plain text. A window may cut a multi-byte
    character, which then decodes to U+FFFD.
    """

    def __init__(self, rank_file, name="bpe"):
        self.name = name
        self.rank_file = rank_file

    def _codec(self):
        """A function giving the codec, loaded once per Python worker."""
        path, pattern = self.rank_file, PRETOKEN

        def load():
            import builtins

            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            cache = builtins.__dict__.setdefault("_docpipe_codecs", {})
            if path not in cache:
                cache[path] = tiktoken.Encoding(
                    "user", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={}
                )
            return cache[path]

        return load

    def encode(self, text):
        load = self._codec()

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode(texts: pd.Series) -> pd.Series:
            codec = load()
            return texts.map(lambda t: None if t is None else codec.encode(t, disallowed_special=()))

        return encode(text)

    def decode(self, tokens):
        load = self._codec()

        @F.pandas_udf(T.StringType())
        def decode(arrays: pd.Series) -> pd.Series:
            codec = load()
            return arrays.map(lambda a: codec.decode([int(t) for t in a]))

        return decode(tokens)


def tokenizer(mode="whitespace", rank_file=None):
    if mode == "whitespace":
        return Whitespace()
    if mode == "pretoken":
        return Pretoken()
    if mode == "bpe":
        if not rank_file:
            raise ValueError("bpe needs a rank file")
        return Bpe(rank_file)
    raise ValueError(f"unknown tokenizer: {mode}")
