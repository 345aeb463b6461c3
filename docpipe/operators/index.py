"""Coarse cells over a vector table."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.config import DEFAULTS


def train_centroids(vectors, nlist=DEFAULTS.nlist, seed=42, max_iter=20, vector="embedding"):
    """(cell, embedding): k-means centres of all rows."""
    train = vectors.select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(train)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centres, "cell int, embedding array<double>")


def collect_centroids(centroids, vector="embedding"):
    """Centroids as a unit matrix, row i = cell i. There are as many as the index has cells (`nlist`)."""
    from docpipe.operators.search import _unit_rows

    table = centroids.select("cell", vector).toArrow().sort_by("cell")
    if table["cell"].to_pylist() != list(range(table.num_rows)):
        raise ValueError("cells must be numbered 0..n-1")
    lists = table[vector].combine_chunks()
    return _unit_rows(lists, len(lists[0]))


def assign_cells(vectors, centroids, vector="embedding"):
    """Add `cell`, the nearest centroid (lowest number on ties). Narrow."""
    from docpipe.operators.search import _unit_rows

    dim = centroids.shape[1]

    @F.arrow_udf(T.IntegerType())
    def nearest(lists):
        import numpy as np
        import pyarrow as pa

        out = np.empty(len(lists), dtype=np.int32)
        step = max(1, 4_000_000 // len(centroids))
        for start in range(0, len(lists), step):
            rows = _unit_rows(lists.slice(start, step), dim)
            out[start:start + step] = np.argmax(np.round(rows @ centroids.T, 9), axis=1)
        return pa.array(out)

    return vectors.withColumn("cell", nearest(F.col(vector)))


def cell_sizes(assigned):
    return assigned.groupBy("cell").agg(F.count("*").alias("n"))


def recall(found, truth, id_col="chunk_id"):
    """(query_id, recall): the share of the true hits that were found."""
    hit = truth.select("query_id", id_col).join(
        found.select("query_id", id_col, F.lit(1).alias("_hit")), ["query_id", id_col], "left"
    )
    return hit.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))
