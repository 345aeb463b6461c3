"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook; a pair of centroids is
a cell. A query visits cells in the order of the summed products with both centroids, taken
from a heap, until the cells visited hold `entries` vectors; all of them are scored on
the original vectors, in double precision.

The codebooks are fitted on at most `SAMPLE` vectors, chosen by a hash; every vector
is indexed. By default `entries` is the share of all vectors at which `CALIBRATED` of the true
neighbours are found within the sample: small where the vectors have structure. A codebook has about sqrt(rows) / 4 centroids, `LARGEST` at most, so the
driver holds at most LARGEST ** 2 cell counts. Cells larger than `BLOCK` are cut into blocks, and so are
the queries that visit a cell: no task holds a whole cell, and nothing is left out.

Nearness is the inner product (largest first), equal ones go to the smaller id.

Handled cases: vectors that are null, empty or zero, or hold null or non-finite components,
and rows without an id, take no part; shorter vectors count as padded with zeros; of
rows with the same id the smallest vector stands for all; with fewer candidates than k a query
returns all; without queries or vectors the result is empty. Other columns are not
carried.
"""

import heapq
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from docpipe.llm.common import sorted_groups
from docpipe.session import materialize

K = 20
CALIBRATED = 0.95   # share of the true neighbours that the visited cells hold, on the sample
SAMPLE = 20_000
LARGEST = 1024
BLOCK = 2048


def codebook(points, size, rounds=12, seed=3):
    """Centroids of `points` (rows) by Lloyd's iterations from spread-out starts."""
    import numpy as np

    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    if len(points) <= size:
        return points
    centres = points[rng.choice(len(points), size, replace=False)]
    for _ in range(rounds):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=size)
        sums = np.stack([np.bincount(own, weights=points[:, d], minlength=size) for d in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = points[rng.choice(len(points), len(empty), replace=False)]
    return centres


def nearest(points, centres):
    """Number of the nearest centre (Euclidean) of each row."""
    import numpy as np

    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([
        np.argmax(points[a:a + 4096] @ centres.T - half, axis=1) for a in range(0, len(points), 4096)
    ]) if len(points) else np.empty(0, dtype=np.int64)


def traverse(first, second, counts, entries):
    """Cells in the order of first[i] + second[j], largest first, until `entries` are seen.

    counts: {(i, j): vectors in the cell}. Pairs come from a heap; a pair is pushed
    once the pairs before it in both directions have been taken.
    """
    import numpy as np

    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap, reached, seen, out = [(-(x[0] + y[0]), 0, 0)], [0] * len(a), 0, []
    while heap and seen < entries:
        _, i, j = heapq.heappop(heap)
        n = counts.get((a[i], b[j]), 0)
        if n:
            out.append((a[i], b[j]))
            seen += n
        reached[i] = j + 1
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
    return out


class MultiIndex:
    """An index over (vec_id, embedding), stored in the shared folder."""

    def __init__(self, embeddings, sample=SAMPLE, largest=LARGEST):
        import numpy as np

        def parse(batches):
            import pyarrow as pa

            from docpipe.llm.vectors import rows

            for batch in batches:
                found = rows(batch.column(1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([None if v is None else v.tobytes() for v in found], pa.binary())], names=["vec_id", "blob"])

        parsed = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")
        parsed = parsed.mapInArrow(parse, "vec_id bigint, blob binary").groupBy("vec_id").agg(F.min("blob").alias("blob"))
        vectors = materialize(parsed.where("blob is not null"), "vectors")
        told = vectors.agg(F.count("*").alias("n"), F.max(F.length("blob")).alias("bytes")).first()
        self.rows, self.dim = told.n, (told.bytes or 16) // 8
        self.cut = max(1, self.dim // 2)
        picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().sort_by("vec_id")
        points = _Padded(self.dim)(picked["blob"].to_pylist())
        size = int(min(largest, max(1, round(np.sqrt(self.rows) / 4))))
        self.books = codebook(points[:, :self.cut], size), codebook(points[:, self.cut:], size)
        self.share = self._calibrate(points)
        self.index = materialize(self._assign(vectors), "index")
        sizes = self.index.groupBy("a", "b").agg(F.count("*").alias("n")).collect()  # at most largest ** 2 rows
        self.counts = {(r.a, r.b): r.n for r in sizes}

    def _calibrate(self, points, queries=200, k=K, recall=CALIBRATED):
        """The share of all vectors to visit, so that on the sample `recall` of the k nearest is found.

        For each of some queries, drawn at random over the whole sample, the vectors in cells
        visited up to that of a true neighbour are counted. In tables with structure that
        is a small share, in random ones a large one.
        """
        import numpy as np

        if len(points) < 2:
            return 1.0
        first, second = self.books
        cell = nearest(points[:, :self.cut], first) * len(second) + nearest(points[:, self.cut:], second)
        own, members = np.unique(cell, return_inverse=True)
        sizes = np.bincount(members)
        shares = []
        for at in np.random.default_rng(5).permutation(len(points))[:queries]:
            q = points[at]
            product = points @ q
            product[at] = -np.inf  # its own product need not be the largest
            closest = np.argsort(-product, kind="stable")[:min(k, len(points) - 1)]
            value = (first @ q[:self.cut])[own // len(second)] + (second @ q[self.cut:])[own % len(second)]
            order = np.argsort(-value, kind="stable")
            visited = np.empty(len(own))
            visited[order] = np.cumsum(sizes[order])
            shares.append(visited[members[closest]] / len(points))
        return float(np.quantile(np.concatenate(shares), recall))

    def _assign(self, vectors):
        cut, books, matrix = self.cut, self.books, _Padded(self.dim)
        if not self.rows:
            return vectors.selectExpr("vec_id", "blob", "0 as a", "0 as b")

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                points = matrix(batch.column(1).to_pylist())
                a, b = nearest(points[:, :cut], books[0]), nearest(points[:, cut:], books[1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(a.astype("int32")), pa.array(b.astype("int32"))], names=["vec_id", "blob", "a", "b"])

        return vectors.select("vec_id", "blob").mapInArrow(run, "vec_id bigint, blob binary, a int, b int")

    def search(self, wanted, k=K, entries=None):
        """query_id, rank, vec_id, score for the indexed vectors that meet the condition `wanted`."""
        counts, cut, books, matrix = self.counts, self.cut, self.books, _Padded(self.dim)
        enough = max(entries or math.ceil(self.share * self.rows), k + 1)

        def probe(batches):
            import pyarrow as pa

            lists = pa.list_(pa.struct([("a", pa.int32()), ("bs", pa.list_(pa.int32()))]))
            for batch in batches:
                points = matrix(batch.column(1).to_pylist())
                first, second = points[:, :cut] @ books[0].T, points[:, cut:] @ books[1].T
                visits = []
                for x, y in zip(first, second, strict=True):
                    by_first = {}
                    for a, b in traverse(x, y, counts, enough):
                        by_first.setdefault(a, []).append(b)
                    visits.append([{"a": a, "bs": bs} for a, bs in by_first.items()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(visits, lists)], names=["id", "blob", "visits"])

        queries = self.index.where(wanted).select("vec_id", "blob")
        probes = queries.mapInArrow(probe, "id bigint, blob binary, visits array<struct<a:int,bs:array<int>>>")
        probes = materialize(probes.select("id", "blob", F.explode("visits").alias("v")).select("id", "blob", "v.a", "v.bs"), "probes")
        # Cells with the same first centroid are stored together, in blocks.
        cut_up = (
            self.index.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
            .join(probes.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "a")
        )
        columns = ["a", "block", "part"]
        entries_of = self.index.join(cut_up, "a").select(
            "a", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.array("b").alias("bs"), F.lit(0).alias("side"),
            F.col("vec_id").alias("id"), "blob")
        asked = probes.join(cut_up, "a").select(
            "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "bs", F.lit(1).alias("side"), "id", "blob")
        width = len(books[1])

        def rerank(batches):
            import numpy as np
            import pyarrow as pa

            for _, table in sorted_groups(batches, 3):
                side, ids = table["side"].to_numpy(), table["id"].to_numpy()
                held, query = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(held) or not len(query):
                    continue
                points, cells = matrix(table["blob"].to_pylist()), table["bs"].to_pylist()
                second = np.array([cells[i][0] for i in held])
                for start in range(0, len(query), 256):
                    mine = query[start:start + 256]
                    visited = np.zeros((len(mine), width), dtype=bool)
                    for row, i in enumerate(mine):
                        visited[row, cells[i]] = True
                    rough = points[mine] @ points[held].T
                    rough[~visited[:, second] | (ids[mine][:, None] == ids[held][None, :])] = -np.inf
                    limit = np.full(len(mine), -np.inf)
                    if len(held) > k:
                        limit = np.partition(rough, len(held) - k, axis=1)[:, -k]
                    near = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(limit), limit, 0.0)))
                    rows, at = np.nonzero((rough > -np.inf) & (rough >= (limit - near)[:, None]))
                    # Summed component by component: equal vectors get equal scores.
                    left, right, score = points[mine[rows]], points[held[at]], np.zeros(len(rows))
                    for d in range(points.shape[1]):
                        score += left[:, d] * right[:, d]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[mine[rows]]), pa.array(ids[held[at]]), pa.array(score)], names=["query_id", "vec_id", "score"])

        met = entries_of.union(asked).repartition(*columns).sortWithinPartitions(*columns)
        scored = met.mapInArrow(rerank, "query_id bigint, vec_id bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Padded:
    """Blobs of doubles -> matrix with `dim` columns."""

    def __init__(self, dim):
        self.dim = dim

    def __call__(self, blobs):
        import numpy as np

        out = np.zeros((len(blobs), self.dim))
        for i, blob in enumerate(blobs):
            v = np.frombuffer(blob, dtype=np.float64)
            out[i, :len(v)] = v
        return out


def nearest_neighbours(embeddings, k=K, entries=None):
    """The k nearest rows of every row whose vec_id is divisible by 20."""
    return MultiIndex(embeddings).search("vec_id % 20 = 0", k, entries)
