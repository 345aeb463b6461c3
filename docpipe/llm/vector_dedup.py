"""Near-duplicate vectors by random-hyperplane sign hashing.

In each of several tables a vector's key is the signs of its products with random
planes. Vectors that share a key in some table are compared by cosine in double
precision; the links give connected components. A pair is counted in the first table where it
meets, so no pair is ever written or made distinct: tasks return, per vector, how many
partners it has, and a spanning set of links for the components.

The number of planes grows with the logarithm of the table, and the number of tables so
that a pair at the threshold meets with probability `RECALL`. Equal vectors are one
class with a weight. A bucket larger than `BLOCK` is split by a hash into blocks, and pairs
of blocks go to different tasks, so no task holds a whole bucket.

Handled cases: vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing; vectors of different lengths never link; a row without vec_id is returned
with no links and a null component; of rows with the same vec_id one stands for
all (the smallest vector, invalid ones first); an empty table gives no rows. Other columns are not carried.
"""

import math

from pyspark.sql import functions as F

from docpipe.llm.common import connected_components, sorted_groups
from docpipe.session import materialize

COSINE = 0.95
RECALL = 0.999
BLOCK = 1024
SEED = 11


def plan(rows, cosine=COSINE, recall=RECALL):
    """(planes per table, tables) for a number of vectors."""
    bits = max(8, min(24, math.ceil(math.log2(max(2, rows))) - 4))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _planes(dim, bits, tables):
    import numpy as np

    return np.random.default_rng([SEED, dim]).normal(size=(dim, tables * bits))


def _keys(matrix, bits, tables):
    """rows x tables of integer keys."""
    import numpy as np

    signs = (matrix @ _planes(matrix.shape[1], bits, tables) >= 0).reshape(len(matrix), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _classes(vectors):
    """(fp, rep, weight, vector blob): valid vectors, equal ones once; and all ids with their fp."""
    def run(batches):
        import hashlib

        import pyarrow as pa

        from docpipe.llm.vectors import rows

        for batch in batches:
            blobs = [None if v is None else v.astype("<f8").tobytes() for v in rows(batch.column(1))]
            prints = [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in blobs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "fp", "blob"])

    return vectors.mapInArrow(run, "vec_id bigint, fp binary, blob binary")


def near_duplicates(embeddings, cosine=COSINE, recall=RECALL):
    """vec_id, n_links, component_id, kept."""
    source = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    hashed = _classes(source)
    # One row per id; a null fp (no valid vector) sorts first.
    ids = hashed.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("fp", "blob")).alias("v"))
    ids = materialize(ids.select("vec_id", "v.fp", "v.blob"), "vectors")
    classes = ids.where("fp is not null").groupBy("fp").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("blob").alias("blob"))
    classes = materialize(classes, "classes")
    bits, tables = plan(classes.count(), cosine, recall)

    def hash_all(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [np.frombuffer(b, dtype="<f8") for b in batch.column(2).to_pylist()]
            keys = [None] * len(found)
            for dim in {len(v) for v in found}:
                at = [i for i, v in enumerate(found) if len(v) == dim]
                for i, k in zip(at, _keys(np.stack([found[j] for j in at]), bits, tables), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["rep", "weight", "blob", "keys"])

    placed = classes.select("rep", "weight", "blob").mapInArrow(hash_all, "rep bigint, weight bigint, blob binary, keys array<bigint>")
    keyed = placed.select("rep", "weight", "blob", F.length("blob").alias("dim"), F.posexplode("keys").alias("place", "key"))
    sizes = placed.select(F.length("blob").alias("dim"), F.posexplode("keys").alias("place", "key")).groupBy("place", "key", "dim").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Row i of a bucket meets its own block and all others: pair (i, j), i <= j.
    met = keyed.join(sizes, ["place", "key", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("place", "key", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "weight", "blob")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def flush(links, edges):
            return pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in links] + [None] * len(edges), pa.int64()),
                pa.array([x[1] for x in links] + [None] * len(edges), pa.int64()),
                pa.array([None] * len(links) + [e[0] for e in edges], pa.int64()),
                pa.array([None] * len(links) + [e[1] for e in edges], pa.int64()),
            ], names=["rep", "links", "a", "b"])

        links, edges = [], []
        for (place, _, _, i, j), table in sorted_groups(batches, 5):
            if table.num_rows < 2:
                continue
            matrix = np.stack([np.frombuffer(b, dtype="<f8") for b in table["blob"].to_pylist()])
            own = table["own"].to_numpy()
            if i != j and (own == own[0]).all():
                continue
            rep, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
            matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # no overflow in the squares
            unit = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            near = unit @ unit.T >= cosine
            near &= near.T
            np.fill_diagonal(near, False)
            if i != j:
                near &= own[:, None] != own[None, :]
            if place and near.any():
                x, y = np.nonzero(np.triu(near))
                keys = _keys(matrix, bits, tables)[:, :place]
                for a in range(0, len(x), 100_000):
                    before = (keys[x[a:a + 100_000]] == keys[y[a:a + 100_000]]).any(axis=1)
                    near[x[a:a + 100_000][before], y[a:a + 100_000][before]] = False
                    near[y[a:a + 100_000][before], x[a:a + 100_000][before]] = False
            count = near @ weight
            links += [(int(r), int(c)) for r, c in zip(rep[count > 0], count[count > 0], strict=True)]
            edges += _forest(near, rep)
            if len(links) + len(edges) > 100_000:
                yield flush(links, edges)
                links, edges = [], []
        yield flush(links, edges)

    columns = ["place", "key", "dim", "i", "j"]
    dealt = met.repartition(*columns).sortWithinPartitions(*columns)
    found = materialize(dealt.mapInArrow(compare, "rep bigint, links bigint, a bigint, b bigint"), "links")
    direct = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("a is not null").select("a", "b"))
    by_class = (
        classes.select("fp", "rep", "weight").join(direct, "rep", "left")
        .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select("fp", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    )
    told = ids.select("vec_id", "fp").join(by_class, "fp", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("part", "vec_id").alias("component_id"))
    told = told.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    unnamed = source.where("vec_id is null").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return told.union(unnamed)


def _forest(near, rep):
    """Spanning links of a small adjacency matrix."""
    import numpy as np

    left = set(np.flatnonzero(near.any(axis=1)).tolist())
    out = []
    while left:
        todo = [left.pop()]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x]).tolist():
                if y in left:
                    left.discard(y)
                    out.append((int(rep[x]), int(rep[y])))
                    todo.append(y)
    return out
