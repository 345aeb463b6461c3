"""Text -> unit vector. An embedder has `dim` and `transform(df, text, out)`."""

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.config import DEFAULTS
from docpipe.functions.text import words

PAIRS_PER_TASK = 2_000_000  # (key, bucket) pairs a task of sparse_buckets adds up


def word_bucket(word, dim):
    """Hash bucket of a word: the first 32 bits of its MD5, modulo `dim`."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim


class HashEmbedder:
    """Hashed bag of words. Lexical, not semantic: needs no model file.

    Runs in the JVM: a fixed vocabulary of bucket numbers lets the count
    vectorizer add up the words of a row, and the normalizer scales the counts.
    """

    def __init__(self, dim=DEFAULTS.embedding_dim):
        self.dim = dim

    def counts(self, df, text="text", out="_counts"):
        """`df` with the words per bucket as a sparse vector."""
        buckets = F.transform(words(F.col(text)), lambda w: word_bucket(w, self.dim).cast("string"))
        hashed = df.withColumn("_buckets", F.coalesce(buckets, F.array().cast("array<string>")))
        counter = CountVectorizerModel.from_vocabulary(
            [str(i) for i in range(self.dim)], inputCol="_buckets", outputCol=out
        )
        return counter.transform(hashed).drop("_buckets")

    def transform(self, df, text="text", out="embedding"):
        scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(self.counts(df, text))
        return scaled.withColumn(out, vector_to_array("_unit", "float32")).drop("_counts", "_unit")


class ModelEmbedder:
    """A model the caller loads: `load()` runs once per Python worker and returns
    a function from a list of texts to a 2-d array. Vectors are scaled to unit
    length here, so a model may return raw ones.
    """

    def __init__(self, load, dim, batch_size=DEFAULTS.embed_batch_size):
        if not 1 <= batch_size <= DEFAULTS.max_embed_batch:
            raise ValueError(f"batch_size must be 1..{DEFAULTS.max_embed_batch}")
        self.load, self.dim, self.batch_size = load, dim, batch_size

    def transform(self, df, text="text", out="embedding"):
        load, dim = self.load, self.dim

        def make_predict():
            import numpy as np

            model = load()

            def predict(texts):
                vectors = np.asarray(model(list(texts)), dtype=np.float64).reshape(len(texts), dim)
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0).astype("float32")

            return predict

        embed = predict_batch_udf(
            make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size
        )
        return df.withColumn(out, embed(F.col(text)))


def sparse_buckets(df, key, text="text", dim=DEFAULTS.embedding_dim):
    """(key, bucket, n): the counts behind HashEmbedder, one row per bucket.

    Words are counted inside their row; rows of one key meet by key and bucket, so a
    hot key spreads over up to `dim` tasks. The number of tasks follows the number of rows, so
    that a task adds up PAIRS_PER_TASK pairs at most on average; rows are counted first.
    """
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(slots, -(-df.count() * dim // PAIRS_PER_TASK))
    counts = HashEmbedder(dim).counts(df.select(key, text), text, "_counts")
    pairs = counts.select(key, F.posexplode(vector_to_array("_counts")).alias("bucket", "n")).where("n > 0")
    return (
        pairs.select(key, F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n"))
        .repartition(tasks, key, "bucket")
        .groupBy(key, "bucket")
        .agg(F.sum("n").alias("n"))
    )
