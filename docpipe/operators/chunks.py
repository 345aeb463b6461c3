"""Overlapping token windows and the chunk rows made of them."""

from pyspark.sql import functions as F

from docpipe.config import DEFAULTS
from docpipe.functions.text import chunk_id
from docpipe.functions.tokens import Whitespace


def token_windows(df, text="text", size=DEFAULTS.chunk_size, overlap=DEFAULTS.chunk_overlap,
                  tokenizer=None, keep=None):
    """One row per window: `keep` columns, chunk_index, total_chunks, n_tokens, text.

    Windows start every size-overlap tokens; the first one that reaches the end
    is the last. A text without tokens gives no row. No shuffle: every window is
    sliced from its own row, and only slices travel past the explode.
    """
    if overlap >= size:
        raise ValueError(f"windows of {size} tokens cannot share {overlap}")
    tokenizer = tokenizer or Whitespace()
    keep = [c for c in (keep if keep is not None else df.columns) if c != text]
    stride = size - overlap

    n = F.size("_tokens")
    last = F.when(n > size, F.ceil((n - size) / F.lit(stride))).otherwise(0).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.slice("_tokens", i * stride + 1, size))
    # The outer explode matters: for an inner one the optimizer adds a "size > 0"
    # filter on the scan, which tokenizes every text again for each window.
    sliced = (
        df.select(*keep, tokenizer.encode(F.col(text)).alias("_tokens"))
        .select(*keep, windows.alias("_windows"), (last + 1).cast("bigint").alias("total_chunks"))
        .select(*keep, "total_chunks", F.posexplode_outer("_windows").alias("_pos", "_window"))
        .where(F.col("_window").isNotNull())
    )
    return sliced.select(
        *keep,
        F.col("_pos").cast("bigint").alias("chunk_index"),
        "total_chunks",
        F.size("_window").cast("bigint").alias("n_tokens"),
        tokenizer.decode(F.col("_window")).alias(text),
    )


def chunk_rows(pages, size=DEFAULTS.chunk_size, overlap=DEFAULTS.chunk_overlap,
               tokenizer=None, created_at=None, keep=()):
    """Page rows (url, title, text, content_hash) -> chunk rows.

    Missing fields default to ''. `created_at` is a column of epoch seconds,
    by default the time of the run. `keep` names page columns to carry along.
    """
    tokenizer = tokenizer or Whitespace()
    if created_at is None:
        created_at = F.unix_seconds(F.current_timestamp())
    ready = pages.select(
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        "text",
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        created_at.cast("bigint").alias("created_at"),
        *keep,
    )
    windows = token_windows(ready, "text", size, overlap, tokenizer)
    key = chunk_id(F.col("url"), F.col("content_hash"), F.col("chunk_index"), size, overlap, tokenizer.name)
    return windows.select(
        key.alias("chunk_id"), "url", "title", "chunk_index", "total_chunks",
        "text", "content_hash", "created_at", "n_tokens", *keep,
    )


def token_count(text, tokenizer=None):
    """Tokens of a text column."""
    return F.size((tokenizer or Whitespace()).encode(text)).cast("bigint")
