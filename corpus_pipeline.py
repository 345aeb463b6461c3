"""From raw documents to a deduplicated, cleaned, mixed and encoded training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. `run` writes every stage's result to the shared folder and
reads it again for the next one, so a lost executor costs part of one stage.
"""

from pyspark.sql import functions as F

from docpipe.llm import bpe, mixing, quality, secrets, shingle_join
from docpipe.llm.common import read_table
from docpipe.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject."""
    docs = docs.select(COLUMNS)
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    machine = quality.fit(docs.where(~quality.held_out(5, 0)), labels.where(~quality.held_out(5, 0)))
    return quality.score(docs, machine).where("predicted = 1").select(COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """The document with the smallest doc_id of each group of near duplicates; rows without doc_id stay."""
    docs = docs.select(COLUMNS)
    kept = shingle_join.similarity_classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(COLUMNS).union(docs.where("doc_id is null"))


def remove_secrets(spark, docs, sf_dir):
    """Every secret becomes its rule's name in brackets; n_chars follows the text where it changes."""
    found = secrets.find_secrets(docs.select(COLUMNS))
    clean = secrets.redact(found)
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them. Rows with the same id, text and source are one document."""
    docs = docs.select(COLUMNS)
    sizes = mixing.sized_documents(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    plan = mixing.mix(sizes.dropDuplicates(["doc_id", "mark", "source"]))
    plan = plan.select("doc_id", "mark", "source", (F.col("epochs") + F.col("once").cast("bigint")).alias("copies")).where("copies > 0")
    keys = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "mark", "source")]
    rows = docs.withColumn("mark", F.xxhash64("text")).alias("d").join(plan.alias("p"), keys[0] & keys[1] & keys[2])
    once = rows.select("d.*", "p.copies").dropDuplicates(["doc_id", "mark", "source"])
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def encode(spark, docs, sf_dir):
    """Token ids of every document and the digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True, keep=False)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("near duplicates", drop_near_copies),
    ("secret scan", remove_secrets),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]

# The classifier and the encoder cannot be written in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
