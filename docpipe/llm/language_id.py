"""Language identification by compression.

For every language a raw-content zstandard dictionary is put together from a bounded
sample of labelled texts. A text is cut into blocks, each block is compressed with
each dictionary, and the language with the smallest total wins: the dictionary that
knows the text's words and endings saves the most bytes. Texts are lower-cased and
runs of other characters than letters become one blank, in dictionaries and texts
alike. Blocks keep long texts from becoming their own dictionary; all blocks of a
text count.

Where the two smallest totals are close, `confident` is false; the query keeps the
better guess, other callers may treat it as rejected.

Handled cases: a null text, or one without a letter, is `und` with score 0; equal totals
go to the first language by code point; no labelled text at all makes every text
`und`. Extra columns stay, columns with the names of new ones are replaced.
"""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.llm.common import add_columns

SAMPLE_DOCS = 256          # labelled texts per language used for its dictionary
SAMPLE_CHARS = 1024        # characters of each of them, taken from its middle
BLOCK_CHARS = 3000         # a text is compressed in blocks of this length
LEVEL = 5
MARGIN = 0.01              # relative saving over the runner-up below which a text is not confident
UNDETERMINED = "und"


def dictionaries(labelled, text="text", lang="lang", docs=SAMPLE_DOCS, chars=SAMPLE_CHARS):
    """{language: dictionary bytes} from at most `docs` different texts of each language.

    The sample is the only thing that is bounded: at most `docs` * `chars`
    characters of each language come to the driver. It is chosen by a hash of the
    piece that the dictionary takes, so it does not depend on the order of the rows,
    and equal pieces, however often they occur, count once. Pieces without a letter
    say nothing about a language and are left out before the choice. Hashes alone
    are shuffled; the chosen pieces come from a second scan.
    """
    body = F.trim(F.col(text))
    # The middle of the text: the same rule for texts of any length.
    start = F.greatest(F.lit(1), ((F.length(body) - chars) / 2).cast("int") + 1)
    pieces = (
        labelled.where(F.col(lang).isNotNull())
        .select(F.col(lang).alias("lang"), F.substring(body, start, F.lit(chars)).alias("piece"))
        .where(F.col("piece").rlike(r"\p{L}"))
        .withColumn("pick", F.xxhash64("piece"))
    )
    order = Window.partitionBy("lang").orderBy("pick")
    chosen = pieces.select("lang", "pick").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs)
    sample = (
        pieces.join(F.broadcast(chosen.select("lang", "pick")), ["lang", "pick"], "left_semi")
        .select("lang", "piece").distinct()
        .groupBy("lang").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    )
    return {r.lang: letters(" ".join(r.pieces)).encode() for r in sample.collect()}


_OTHER = re.compile(r"[\W\d_]+")


def letters(text):
    return _OTHER.sub(" ", text.lower())


def identify(df, models, text="text", block=BLOCK_CHARS, level=LEVEL, margin=MARGIN):
    """`df` with lang_pred, score (0 to 1) and confident."""
    names = sorted(models)

    def make():
        import pyarrow as pa
        import zstandard

        coders = []
        size = max(map(len, models.values()), default=0)
        settings = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=size, source_size=block, write_content_size=False, write_dict_id=False)
        for name in names:
            known = zstandard.ZstdCompressionDict(models[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=settings)
            coders.append(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress)

        def one(value):
            if not value or not names or not any(map(str.isalpha, value)):
                return UNDETERMINED, 0.0, False
            value = letters(value)
            blocks = [value[i:i + block].encode() for i in range(0, len(value), block)]
            totals = [sum(len(c(b)) for b in blocks) for c in coders]
            best = min(range(len(names)), key=totals.__getitem__)
            rest = min((t for i, t in enumerate(totals) if i != best), default=2 * totals[best])
            saved = (rest - totals[best]) / rest
            # Half at a tie, towards 1 as the saving grows.
            return names[best], 0.5 + 0.5 * min(1.0, saved / 0.2), saved >= margin

        def run(texts):
            found = [one(v) for v in texts.to_pylist()]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_())]

        return run

    return add_columns(df, make, [text], [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("confident", T.BooleanType()),
    ])


def held_out(parts, rest):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest


def languages(documents):
    """doc_id, held_out, lang_pred, score, confident for every document. Rows without doc_id are held out."""
    rows = documents.select("doc_id", "text", "lang", F.coalesce(held_out(4, 2), F.lit(True)).alias("held_out"))
    models = dictionaries(rows.where("not held_out"))
    return identify(rows.select("doc_id", "held_out", "text"), models).drop("text")
