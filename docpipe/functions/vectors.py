"""Vector functions on array columns, in double precision."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F


def dot(a, b):
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v):
    """Unit vector; the zero vector stays zero. The sum is taken once per row."""
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda total: F.transform(
            v, lambda x: F.when(total > 0, x.cast("double") / F.sqrt(total)).otherwise(F.lit(0.0))
        ),
    )


def cosine(a, b):
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def dimension(v):
    return F.size(v).cast("bigint")


def mean_vectors(df, key, vector):
    """One unit mean vector per key; sums are combined before the shuffle."""
    return (
        df.groupBy(key)
        .agg(Summarizer.mean(array_to_vector(F.col(vector))).alias("_mean"))
        .select(key, l2_normalize(vector_to_array("_mean")).alias(vector))
    )
