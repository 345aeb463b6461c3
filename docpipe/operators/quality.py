"""Field defaults and table constraints."""

from pyspark.sql import functions as F

from docpipe.config import DEFAULTS
from docpipe.schemas import BYTE_LIMITS


def with_event_defaults(events, now=None):
    """Fill optional chunk-event fields; chunk_id and text stay mandatory."""
    now = F.unix_seconds(F.current_timestamp()) if now is None else now
    defaults = {
        "url": F.lit(""), "title": F.lit(""), "chunk_index": F.lit(0), "total_chunks": F.lit(1),
        "content_hash": F.lit(""), "created_at": now,
    }
    kinds = {f.name: f.dataType for f in events.schema.fields}
    return events.withColumns(
        {c: F.coalesce(F.col(c), d.cast(kinds[c])) for c, d in defaults.items() if c in kinds}
    )


def row_violations(rows, dim=DEFAULTS.embedding_dim, vector="embedding", key="chunk_id"):
    """Array column of the row-level constraints a row breaks."""
    checks = [
        F.when(F.octet_length(c) > n, F.lit(f"{c}_too_long"))
        for c, n in BYTE_LIMITS.items() if c in rows.columns
    ]
    checks.append(F.when(F.col(key).isNull(), F.lit(f"{key}_null")))
    if vector in rows.columns:
        checks.append(F.when(F.col(vector).isNull() | (F.size(vector) != dim), F.lit("wrong_dimension")))
    return F.array_compact(F.array(*checks))


def constraint_violations(rows, dim=DEFAULTS.embedding_dim, vector="embedding", key="chunk_id"):
    """(key, violation), one row per broken constraint, duplicates of the key included."""
    broken = rows.select(key, F.explode(row_violations(rows, dim, vector, key)).alias("violation"))
    repeated = (
        rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
        .select(key, F.lit(f"{key}_duplicate").alias("violation"))
    )
    return broken.unionByName(repeated)


def quarantine(rows, dim=DEFAULTS.embedding_dim, vector="embedding", strict=False):
    """(kept, dead). Without `strict`, only rows lacking id or text are set apart."""
    reasons = F.array_compact(F.array(
        F.when(F.col("chunk_id").isNull(), F.lit("chunk_id_null")),
        F.when(F.col("text").isNull(), F.lit("text_null")),
    ))
    if strict:
        reasons = F.array_distinct(F.concat(reasons, row_violations(rows, dim, vector)))
    marked = rows.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
