import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docpipe.operators import embed, index, search

DIM = 16


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(2000, DIM)).astype("float32")
    vectors[500:1200] = vectors[500]          # a third of the rows are copies
    queries = rng.normal(size=(37, DIM)).astype("float32")
    queries[0] = vectors[500]
    corpus = spark.createDataFrame(
        [(f"c{i:05d}", f"text {i}", v.tolist()) for i, v in enumerate(vectors)],
        "chunk_id string, text string, embedding array<float>").repartition(7).cache()
    asked = spark.createDataFrame(
        [(i, q.tolist(), 1 + i % 9) for i, q in enumerate(queries)],
        "query_id bigint, embedding array<float>, top_k int").cache()
    scores = np.round(unit(queries.astype(float)) @ unit(vectors.astype(float)).T, 9)
    truth = {}
    for q in range(len(queries)):
        order = sorted(range(len(vectors)), key=lambda i: (-scores[q, i], i))
        truth[q] = [(f"c{i:05d}", round(float(scores[q, i]), 4)) for i in order[:50]]
    return corpus, asked, truth


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_exact_equals_brute_force_with_ties(data):
    corpus, asked, truth = data
    got = hits(search.exact_search(corpus, asked))
    assert got == {q: truth[q][: 1 + q % 9] for q in truth}


def test_k50_and_payload(data):
    corpus, asked, truth = data
    out = search.exact_search(corpus, asked.drop("top_k"), 50, payload=["text"])
    assert hits(out) == truth
    assert out.columns == ["query_id", "rank", "chunk_id", "text", "score"]
    assert all(int(r.chunk_id[1:]) == int(r.text.split()[1]) for r in out.collect())


def test_more_queries_than_one_block(data):
    corpus, asked, truth = data
    got = hits(search.exact_search(corpus, asked, payload=["text"], block_rows=10))
    assert got == {q: truth[q][: 1 + q % 9] for q in truth}


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_rows_with_the_same_query_id_are_queries_of_their_own(data, cells, block_rows):
    """Each row gets its top_k, whatever the number of rows, and also where rows are equal."""
    corpus, asked, truth = data
    one = asked.where("query_id < 12").withColumn("query_id", F.col("query_id") % 3)
    twice = one.union(one)
    want = sorted((q % 3, rank, *hit) for q in range(12) for rank, hit in enumerate(truth[q][: 1 + q % 9], 1) for _ in range(2))
    placed, centroids = cells
    for found in (search.exact_search(corpus, twice, block_rows=block_rows),
                  search.cell_search(placed, centroids, twice, nprobe=12, block_rows=block_rows)):
        assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in found.collect()) == want


def test_no_queries(data):
    corpus, asked, _ = data
    assert search.exact_search(corpus, asked.where("query_id < 0")).count() == 0


def test_query_row_pairs_are_not_materialised(data):
    corpus, asked, _ = data
    plan = search.exact_search(corpus, asked)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "WindowGroupLimit" in plan


@pytest.fixture(scope="module")
def cells(data):
    corpus, _, _ = data
    centroids = index.collect_centroids(index.train_centroids(corpus, nlist=12, max_iter=5))
    return index.assign_cells(corpus, centroids).cache(), centroids


def test_all_cells_equal_exact_and_recall_grows(data, cells):
    _, asked, truth = data
    corpus, centroids = cells
    exact = search.exact_search(corpus, asked, payload=[])
    last = 0.0
    for nprobe in (1, 3, 12):
        found = search.cell_search(corpus, centroids, asked, nprobe=nprobe)
        mean = index.recall(found, exact).agg(F.avg("recall")).first()[0]
        assert mean >= last
        last = mean
    assert last == 1.0
    assert hits(search.cell_search(corpus, centroids, asked, nprobe=12)) == {q: truth[q][: 1 + q % 9] for q in truth}


def test_cells_are_the_nearest_centroids(data, cells):
    corpus, centroids = cells
    for r in corpus.sample(0.05, seed=1).collect():
        v = np.array(r.embedding, dtype=float)
        assert r.cell == int(np.argmax(np.round(centroids @ (v / np.linalg.norm(v)), 9)))
    assert index.cell_sizes(corpus).agg(F.sum("n")).first()[0] == 2000


def test_probed_partitions_only(spark, data, cells, tmp_path):
    corpus, centroids = cells
    _, asked, truth = data
    path = str(tmp_path / "table")
    corpus.write.partitionBy("cell").parquet(path)
    one = asked.where("query_id = 0")
    found = search.cell_search(spark.read.parquet(path), centroids, one, nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert hits(found)[0] == truth[0][:1]


def test_query_validation(spark):
    data = [(1, "  hi ", None), (2, "", 5), (3, "   ", 5), (4, "x" * 2048, 1), (5, "x" * 2049, 1),
            (6, "a", 0), (7, "a", 51), (8, "a", 50), (9, None, 5), (10, " " + "x" * 2048, 5)]
    asked = spark.createDataFrame(data, "query_id int, text string, top_k int")
    got = {r.query_id: (r.reason, r.top_k) for r in search.valid_queries(asked).collect()}
    assert {q: r for q, (r, _) in got.items()} == {
        1: None, 2: "empty", 3: "blank", 4: None, 5: "too_long", 6: "bad_top_k", 7: "bad_top_k", 8: None,
        9: "empty", 10: "too_long"}
    assert got[1][1] == 5
    valid, rejected = search.split_queries(asked)
    assert valid.count() == 3 and rejected.count() == 7
    assert valid.where("query_id = 1").first().text == "hi"


def test_hash_embedder(spark):
    df = spark.createDataFrame([(1, "Red red BLUE"), (2, "..."), (3, None)], "i int, text string")
    out = {r.i: np.array(r.embedding) for r in embed.HashEmbedder().transform(df).collect()}
    import hashlib

    spot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384
    want = np.zeros(384)
    want[spot("red")] += 2
    want[spot("blue")] += 1
    assert np.allclose(out[1], want / np.linalg.norm(want), atol=1e-7)
    assert not out[2].any() and not out[3].any() and len(out[3]) == 384


def test_model_embedder_batches_and_scales(spark):
    def load():
        return lambda texts: [[len(texts), 0.0, float(len(t))] for t in texts]

    df = spark.range(70).select("id", F.lit("abc").alias("text")).coalesce(1)
    out = embed.ModelEmbedder(load, 3, batch_size=32).transform(df).collect()
    vectors = np.array([r.embedding for r in out])
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-6)
    sizes = np.round(3 * vectors[:, 0] / vectors[:, 2]).astype(int)
    assert sizes.max() <= 32 and sizes.min() >= 1
    with pytest.raises(ValueError):
        embed.ModelEmbedder(load, 3, batch_size=513)


def test_verbatim_passages_are_found(spark):
    """Benchmark items that occur in a document: how often a hit holds the text."""
    from docpipe.plans.catalog import _benchmark_queries, _document_chunks

    sf = "/root/testdata/sf0.01"
    chunks = _document_chunks(spark, sf)
    items = _benchmark_queries(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("doc"))
    truth = items.join(docs, F.col("doc").contains(F.col("text"))).select("query_id", F.sha2("doc", 256).alias("content_hash"))
    found = search.search_text(embed.HashEmbedder().transform(chunks), items.withColumn("top_k", F.lit(50)), embed.HashEmbedder())
    found = found.join(chunks.select("chunk_id", "content_hash"), "chunk_id")
    asked = truth.select("query_id").distinct().count()
    good = truth.join(found, ["query_id", "content_hash"], "left_semi").select("query_id").distinct().count()
    assert asked == 20 and good / asked >= 0.5


def test_corpus_is_scored_where_it_lies(spark, data, tmp_path):
    """No exchange lies between the corpus scan and the scoring; only hits are shuffled."""
    corpus, asked, _ = data
    corpus.write.parquet(str(tmp_path / "corpus"))
    stored = spark.read.parquet(str(tmp_path / "corpus"))
    plan = search.exact_search(stored, asked, payload=[])._jdf.queryExecution().executedPlan().treeString()
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "MapInArrow" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = []
    for line in lines[at + 1:]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert below and not any("Exchange" in line for line in below)


def test_a_task_holds_a_stretch_of_its_split(data, monkeypatch, tmp_path):
    """Hits of the first rows come out while later rows of the split are still unread."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    asked = pa.table({"row": [0, 1], "query_id": [7, 8], "top_k": pa.array([2, 3], pa.int32()),
                      "asked": pa.array(rng.normal(size=(2, DIM)).tolist(), pa.list_(pa.float32()))})
    pq.write_table(asked, tmp_path / "part.parquet")
    vectors = pa.array(rng.normal(size=(400, DIM)).tolist(), pa.list_(pa.float32()))
    whole = pa.RecordBatch.from_arrays([pa.array([f"c{i:03d}" for i in range(400)]), vectors], names=["id", "vector"])
    read = []

    def batches():
        for start in range(0, 400, 20):
            read.append(start)
            yield whole.slice(start, 20)

    monkeypatch.setattr(search, "_HELD_BYTES", 3 * whole.slice(0, 20).nbytes)
    run = search._score_stretches([[str(tmp_path / "part.parquet")]], "chunk_id")
    out = run(batches())
    first = next(out)
    assert len(read) <= 4 and first.num_rows == 5
    assert sum(b.num_rows for b in out) + 5 == 5 * -(-20 // 3)
    corpus, queries, truth = data
    monkeypatch.setattr(search, "_HELD_BYTES", 2000)
    monkeypatch.setattr(search, "_FLOATS_PER_SLICE", 10 * DIM)
    found = hits(search.exact_search(corpus, queries))
    assert all(found[q] == truth[q][:1 + q % 9] for q in truth)


def test_sparse_buckets_take_more_tasks_for_more_rows(spark, monkeypatch):
    texts = [(1, "a b a"), (1, "b c"), (None, "a"), (None, "a a"), (2, ""), (3, None), (4, " ".join("xyz") * 50)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = {}
    for key, text in texts:
        for word in (text or "").split():
            bucket = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16
            want[key, bucket] = want.get((key, bucket), 0) + 1
    monkeypatch.setattr(embed, "PAIRS_PER_TASK", 8)
    got = embed.sparse_buckets(docs, "doc_id", dim=16)
    assert {(r.doc_id, r.bucket): r.n for r in got.collect()} == want and got.count() == len(want)
    assert got.rdd.getNumPartitions() == len(texts) * 16 // 8
