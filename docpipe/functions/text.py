"""Text functions as Spark column expressions."""

from pyspark.sql import functions as F

# The code points Python's str.split() treats as white space. The
# leading intersection settles printable ASCII with one table lookup.
SPACE = (
    r"[[^!-~]&&[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)

# Fixed value: the published cl100k split pattern. Its pieces concatenate back
# to the input.
PRETOKEN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)


def collapse_space(text):
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip_space(text):
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def content_hash(text):
    return F.sha2(text, 256)


def iso_utc(ts):
    """ISO-8601 in UTC with microseconds, as written on the wire, whatever the
    time zone of the session."""
    micros = F.unix_micros(ts)
    day = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    clock = F.pmod(micros, F.lit(86_400_000_000))
    second = F.floor(clock / F.lit(1_000_000))
    return F.format_string(
        "%sT%02d:%02d:%02d.%06d+00:00",
        F.date_from_unix_date(day).cast("string"),
        F.floor(second / F.lit(3600)), F.floor(second / F.lit(60)) % 60, second % 60, clock % 1_000_000,
    )


def words(text):
    """Lower-cased letter/digit runs."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def chunk_id(url, content_hash, chunk_index, size, overlap, tokenizer):
    """Deterministic 64-character id: re-running a stage repeats its ids."""
    parts = [url, content_hash, chunk_index.cast("string"),
             F.lit(str(size)), F.lit(str(overlap)), F.lit(tokenizer)]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
