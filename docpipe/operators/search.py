"""Top-k cosine search for batches of queries.

Each row of the queries is a query of its own, also where query_ids repeat: it gets
its own `top_k` rows, ranked from 1. Queries are stored once with a row number.

Exact search keeps the corpus in place: the queries are written in parts of about
`query_block_rows` rows, one folder each, below the shared folder; every task of the
corpus scan reads its split in stretches of about `_HELD_BYTES` and takes the stored
parts one after another against each, scoring with matrix products and keeping the
best k rows per query, so a task's memory does not follow its split. Only those
rows are shuffled, by query row, and ranked.
The corpus vectors never pass through an exchange, and no query goes through the driver.

Search by cells joins the stored corpus, partitioned by cell, with the probed cells
(at most as many as the index has), so that dynamic partition pruning reads the
probed cells' files only; no list of cells passes through the driver. Their rows are
cut into blocks by a hash of id and vector, and the queries into parts; every block
meets every part in one task. Query-row pairs are never materialised.
"""

from itertools import chain, groupby

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.config import DEFAULTS
from docpipe.functions.text import strip_space
from docpipe.schemas import HIT_COLUMNS
from docpipe.session import materialize, scratch_dir

_CELLS_PER_SLICE = 4_000_000  # scores held at once by a task
_FLOATS_PER_SLICE = 1_000_000  # vector components made double at once
_HELD_BYTES = 32 << 20  # corpus vectors held at once by a task


def valid_queries(queries, settings=DEFAULTS):
    """Label each query row: stripped text, effective top_k and `reason` (null if valid).

    The length is checked before stripping.
    """
    text = strip_space(F.col("text"))
    k = F.coalesce(F.col("top_k"), F.lit(settings.default_top_k)).cast("int")
    length = F.length("text")
    reason = (
        F.when(F.col("text").isNull() | (length < 1), "empty")
        .when(length > settings.max_query_chars, "too_long")
        .when(text == "", "blank")
        .when((k < 1) | (k > settings.max_top_k), "bad_top_k")
    )
    return queries.select(
        *[c for c in queries.columns if c not in ("text", "top_k")],
        text.alias("text"), k.alias("top_k"), reason.alias("reason"),
    )


def split_queries(queries, settings=DEFAULTS):
    """(valid, rejected)"""
    labelled = valid_queries(queries, settings)
    return labelled.where("reason is null").drop("reason"), labelled.where("reason is not null")


def exact_search(corpus, queries, top_k=DEFAULTS.default_top_k, id_col="chunk_id", payload=(),
                 vector="embedding", block_rows=DEFAULTS.query_block_rows):
    """Exact top-k of every query over the whole corpus.

    queries: (query_id, <vector>) and optionally top_k per row.
    Result: query_id, rank, <id_col>, <payload>, score. Equal scores (nine
    digits) rank by id. Rows with the same query_id are separate queries. Rows
    without a vector have no hits.
    """
    return _search(corpus, queries, top_k, id_col, payload, vector, block_rows, None, None)


def cell_search(corpus, centroids, queries, top_k=DEFAULTS.default_top_k, nprobe=DEFAULTS.nprobe,
                id_col="chunk_id", payload=(), vector="embedding",
                block_rows=DEFAULTS.query_block_rows):
    """Top-k over the `nprobe` cells nearest to each query.

    corpus: has a `cell` column; stored partitioned by it, only the probed
    partitions are read. centroids: array of unit vectors from
    `index.collect_centroids`. With nprobe = number of cells this equals
    `exact_search`.
    """
    return _search(corpus, queries, top_k, id_col, payload, vector, block_rows, centroids, nprobe)


def _search(corpus, queries, top_k, id_col, payload, vector, block_rows, centroids, nprobe):
    spark = corpus.sparkSession
    if "top_k" not in queries.columns:
        queries = queries.withColumn("top_k", F.lit(top_k))
    queries = queries.where(F.col(vector).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), "query_id", F.col("top_k").cast("int").alias("top_k"),
        F.col(vector).alias("asked"))
    if centroids is not None:
        queries = _with_cells(queries, centroids, nprobe)
    queries = materialize(queries, "queries")  # row numbers are fixed, none is embedded again
    rows = corpus.where(F.col(vector).isNotNull())
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if centroids is None:
        return _ranked(_in_place(rows, queries, id_col, vector, block_rows), queries, id_col, rows, payload)
    else:
        queries = queries.withColumn("cell", F.explode("cells"))
        # At most as many rows as the index has cells: broadcast, and the join on the
        # partition column prunes the stored corpus to the probed cells at run time.
        probed = F.broadcast(queries.select(F.col("cell").cast(rows.schema["cell"].dataType).alias("cell")).distinct())
        rows = rows.join(probed, "cell")
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        asked = queries.groupBy(F.col("cell").cast(rows.schema["cell"].dataType).alias("cell")).agg(F.count("*").alias("q"))
        everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cut_up = F.broadcast(sizes.join(asked, "cell").select(
            F.col("cell").cast("int").alias("cell"),
            F.ceil(F.lit(slots) * F.col("n") / F.sum("n").over(everything)).cast("int").alias("blocks"),
            F.ceil(F.col("q") / F.lit(block_rows)).cast("int").alias("parts")))
        queries = queries.withColumn("cell", F.col("cell").cast("int")).join(cut_up, "cell")
        met = rows.select(id_col, vector, F.col("cell").cast("int").alias("cell")).join(cut_up, "cell")

    columns = ["cell", "block", "part", "side"]
    held = queries.select(
        F.col("cell").cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"),
        "row", "query_id", "top_k", "asked")
    passing = met.select(
        F.col("cell").cast("int").alias("cell"), F.pmod(F.xxhash64(id_col, vector), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"),
        F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    dealt = held.unionByName(passing, allowMissingColumns=True).select(
        *columns, "row", "query_id", "top_k", "asked", "id", "vector")
    schema = T.StructType([
        T.StructField("row", T.LongType()),
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("top_k", T.IntegerType()),
        T.StructField(id_col, corpus.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    scored = dealt.repartition(*columns[:3]).sortWithinPartitions(*columns).mapInArrow(_score_groups(id_col), schema)
    return _ranked(scored, queries, id_col, rows, payload)


def _ranked(scored, queries, id_col, rows, payload):
    """The best top_k rows per query row, ranked, with the payload of the hits."""
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc(id_col))
    k = queries.agg(F.max("top_k")).first()[0] or 1  # a constant bound lets Spark cut each part before the shuffle
    hits = (
        scored.withColumn("rank", F.row_number().over(best))
        .where((F.col("rank") <= k) & (F.col("rank") <= F.col("top_k")))
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), id_col,
                F.round("score", 4).alias("score"))
    )
    if not payload:
        return hits
    # Text and titles are fetched for the hits alone, with a second, vector-free scan.
    return rows.select(id_col, *payload).join(hits, id_col).select("query_id", "rank", id_col, *payload, "score")


def _hit_schema(queries, corpus, id_col):
    return T.StructType([
        T.StructField("row", T.LongType()),
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("top_k", T.IntegerType()),
        T.StructField(id_col, corpus.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _in_place(rows, queries, id_col, vector, block_rows):
    """Best rows per query of every corpus task, the corpus read where it lies."""
    spark = rows.sparkSession
    parts = max(1, -(-queries.count() // block_rows))
    path = scratch_dir(spark, "query-parts")
    queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).write.partitionBy("part").parquet(path)
    stored = {}
    for name in spark.read.schema(queries.schema).parquet(path).inputFiles():
        stored.setdefault(name.rsplit("/", 2)[-2], []).append(name)
    by_part = [sorted(files) for _, files in sorted(stored.items())]

    corpus = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    return corpus.mapInArrow(_score_stretches(by_part, id_col), _hit_schema(queries, rows, id_col))


def _score_stretches(by_part, id_col):
    """Function over a task's corpus batches -> the best rows per query of each stretch of them."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        for held in _stretches(batches):
            for files in by_part:
                table = pa.concat_tables([_read_parquet(f, pq) for f in files])
                if not table.num_rows:
                    continue
                lists = table["asked"].combine_chunks()
                score = _scorer(table["row"].combine_chunks(), table["query_id"].combine_chunks(), _unit_rows(lists, len(lists[0])),
                                table["top_k"].fill_null(0).to_numpy().astype(np.int64), id_col)
                yield from score(iter(held))

    return run


def _stretches(batches):
    """Lists of batches of about `_HELD_BYTES` together; a single larger batch stays whole."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > _HELD_BYTES:
            yield held
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield held


def _read_parquet(name, pq):
    """A stored parquet file, by a local path or any URI that pyarrow's file systems open."""
    from pyarrow import fs

    if name.startswith("file:"):
        return pq.read_table("/" + name[len("file:"):].lstrip("/"))
    filesystem, inner = fs.FileSystem.from_uri(name)
    return pq.read_table(inner, filesystem=filesystem)


def _with_cells(queries, centroids, nprobe):
    """The queries with the numbers of the cells they look into."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("asked")
            mask = _probe_mask(_unit_rows(lists, len(lists[0])), centroids, nprobe)
            cells = pa.array([np.flatnonzero(m).tolist() for m in mask.T], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return queries.mapInArrow(run, T.StructType([*queries.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _probe_mask(matrix, centroids, nprobe):
    """cells x queries: which cells each query looks into."""
    import numpy as np

    nearness = np.round(centroids @ matrix.T, 9)
    order = np.argsort(-nearness, axis=0, kind="stable")[:nprobe]
    mask = np.zeros(nearness.shape, dtype=bool)
    np.put_along_axis(mask, order, True, axis=0)
    return mask


def _unit_rows(lists, dim):
    """An Arrow list column as a float64 matrix of unit rows (zero rows stay zero)."""
    import numpy as np

    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), dim)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _score_groups(id_col):
    """Function over Arrow batches sorted by (cell, block, part, side) -> the best rows per query of each group.

    The queries of a group (side 0) come before its corpus rows and are held; those stream past.
    """
    def runs(batches):
        import numpy as np

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(starts, starts[1:], strict=False):
                yield tuple(keys[:3, a].tolist()), keys[3, a], batch.slice(a, b - a)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, group in groupby(runs(batches), key=lambda r: r[0]):
            asked = []
            for _, side, rows in group:
                if side == 0:
                    asked.append(rows)
                    continue
                if asked:
                    table = pa.Table.from_batches(asked)
                    lists = table["asked"].combine_chunks()
                    score = _scorer(
                        table["row"].combine_chunks(), table["query_id"].combine_chunks(), _unit_rows(lists, len(lists[0])),
                        table["top_k"].fill_null(0).to_numpy().astype(np.int64), id_col)
                    yield from score(r for r in chain([rows], (r for _, _, r in group)))
                break

    return run


def _scorer(row_ids, query_ids, matrix, limits, id_col):
    """Function over the corpus rows of one group -> its best rows per query."""
    import numpy as np

    n_queries, dim = matrix.shape
    k = max(1, int(limits.max()))
    slice_rows = max(1, min(_CELLS_PER_SLICE // n_queries, _FLOATS_PER_SLICE // dim))
    flush_rows = max(2 * n_queries * k, 100_000)

    def best(table, pa):
        """Keep the top k rows of every query; also each query's k-th score."""
        order = pa.compute.sort_indices(
            table, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]
        )
        table = table.take(order)
        q = table["q"].to_numpy()
        first = np.searchsorted(q, np.arange(n_queries))
        place = np.arange(len(q)) - first[q]
        floor = np.full(n_queries, -np.inf)
        at_k = place == k - 1
        floor[q[at_k]] = table["score"].to_numpy()[at_k]
        return table.filter(pa.array(place < limits[q])), floor

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute

        kept, pending, floor = [], 0, np.full(n_queries, -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                scores = np.round(_unit_rows(part.column("vector"), dim) @ matrix.T, 9)
                bar = floor
                if len(scores) > k:
                    bar = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[-k])
                rows, q = np.nonzero(scores >= bar)
                kept.append(pa.table({
                    "q": pa.array(q), "id": part.column("id").take(pa.array(rows)),
                    "score": pa.array(scores[rows, q]),
                }))
                pending += len(rows)
                if pending > flush_rows:
                    table, floor = best(pa.concat_tables(kept), pa)
                    kept, pending = [table], 0
        if kept:
            table, _ = best(pa.concat_tables(kept), pa)
            q = table["q"].combine_chunks()
            out = pa.table({
                "row": row_ids.take(q),
                "query_id": query_ids.take(q),
                "top_k": pa.array(limits[q.to_numpy()], pa.int32()),
                id_col: table["id"],
                "score": table["score"],
            })
            yield from out.to_batches()

    return run


def search_text(corpus, queries, embedder, centroids=None, nprobe=DEFAULTS.nprobe, settings=DEFAULTS):
    """Text queries -> ranked chunks. Invalid queries give no hits (see `split_queries`)."""
    valid, _ = split_queries(queries, settings)
    vectors = embedder.transform(valid, "text", "embedding").select("query_id", "top_k", "embedding")
    payload = [c for c in HIT_COLUMNS if c != "chunk_id"]
    if centroids is None:
        return exact_search(corpus, vectors, payload=payload)
    return cell_search(corpus, centroids, vectors, nprobe=nprobe, payload=payload)
