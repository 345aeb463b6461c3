"""Settings with the defaults every operator falls back on."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    url_filter: str = "/docs/concepts/"
    max_pages: int = 500
    chunk_size: int = 512
    chunk_overlap: int = 64
    embedding_dim: int = 384
    embed_batch_size: int = 32
    max_embed_batch: int = 512
    batch_seconds: float = 2.0
    default_top_k: int = 5
    max_top_k: int = 50
    max_query_chars: int = 2048
    nlist: int = 128
    nprobe: int = 16
    retention: str = "24 hours"
    throughput_window_seconds: int = 60
    query_block_rows: int = 4096        # query vectors one task holds at a time


DEFAULTS = Settings()
