import numpy as np
import pytest

from docpipe.llm import multi_index, vector_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, component_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows], SCHEMA)


def near_cluster(rng, n, noise, dim=24):
    centre = rng.normal(size=dim)
    return [(centre + noise * rng.normal(size=dim)).astype("float32").tolist() for _ in range(n)]


def links(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], dtype="float32").astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= cosine
    np.fill_diagonal(near, False)
    part = {i: i for i in ids}
    for _ in ids:
        for a, b in zip(*np.nonzero(near)):
            part[ids[a]] = part[ids[b]] = min(part[ids[a]], part[ids[b]])
    return {i: (int(near[k].sum()), part[i]) for k, i in enumerate(ids)}


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(8)
    vectors = near_cluster(rng, 60, 0.2) + near_cluster(rng, 40, 0.15) + [rng.normal(size=24).astype("float32").tolist() for _ in range(200)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]]]
    return list(enumerate(vectors))


@pytest.mark.parametrize("block", [1024, 8])
def test_links_equal_all_pairs(spark, cloud, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vector_dedup.near_duplicates(frame(spark, cloud).repartition(3), recall=0.999999).collect()
    want = links(cloud)
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def odd(cloud):
    v = cloud[0][1]
    nan, inf = float("nan"), float("inf")
    return [(0, v), (1, v), (1, v), (2, None), (3, []), (4, [0.0] * 24), (5, [nan] * 24), (6, [inf] + v[1:]), (7, [None] + v[1:]), (None, v), (None, None),
            (8, v[:5]), (20, v)]


def test_invalid_vectors_link_with_nothing(spark, cloud):
    rows = vector_dedup.near_duplicates(frame(spark, odd(cloud))).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is not None}
    assert by[0] == (2, 0, True) and by[1] == (2, 0, False) and by[20] == (2, 0, False)
    assert all(by[i] == (0, i, True) for i in range(2, 9))
    assert sum(r.vec_id is None for r in rows) == 2
    assert vector_dedup.near_duplicates(frame(spark, [])).count() == 0


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype="float32").astype(float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.array([sum(a * b for a, b in zip(m[q], x)) for x in m])
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_all_entries_give_the_exact_result(spark, cloud, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    got = {}
    for r in multi_index.nearest_neighbours(frame(spark, cloud), entries=10**6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(cloud, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = multi_index.nearest_neighbours(frame(spark, rows)).collect()
    want = exact(rows, 20)
    hit = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in found)
    assert hit / sum(map(len, want.values())) >= 0.9
    assert len(found) == 20 * len(want)


def test_recall_where_the_first_ids_are_tight_copies(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(near_cluster(rng, 600, 0.001) + rng.normal(size=(1400, 24)).astype("float32").tolist()))
    hit, all_of = {True: 0, False: 0}, {True: 0, False: 0}
    want = exact(rows, 20)
    for r in multi_index.nearest_neighbours(frame(spark, rows)).collect():
        hit[r.query_id < 600] += r.vec_id in {i for i, _ in want[r.query_id]}
    for q, found in want.items():
        all_of[q < 600] += len(found)
    assert sum(hit.values()) / sum(all_of.values()) >= 0.9 and hit[False] / all_of[False] >= 0.9


def test_calibration_leaves_out_the_query_by_its_place():
    """The vectors of one direction have a larger product with their longer neighbour than with themselves."""
    index = object.__new__(multi_index.MultiIndex)
    points = np.array([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [0.0, 2.0]])
    index.cut, index.books = 1, (np.array([[0.0], [1.0], [2.0]]), np.array([[0.0], [1.0], [2.0]]))
    # The one nearest neighbour: of the short ones the long one, in the first cell of the traversal; of the long ones the short one, in the second.
    assert index._calibrate(points, k=1, recall=1.0) == 0.5
    assert index._calibrate(points, k=1, recall=0.0) == 0.25


def test_traversal_takes_pairs_in_order():
    rng = np.random.default_rng(2)
    first, second = rng.normal(size=6), rng.normal(size=5)
    counts = {(i, j): 1 for i in range(6) for j in range(5) if (i + j) % 4}
    got = multi_index.traverse(first, second, counts, 10**6)
    sums = [first[i] + second[j] for i, j in got]
    assert len(got) == len(counts) and sums == sorted(sums, reverse=True)
    assert len(multi_index.traverse(first, second, counts, 7)) == 7


def test_odd_vectors_take_no_part(spark, cloud):
    rows = multi_index.nearest_neighbours(frame(spark, odd(cloud))).collect()
    assert {r.query_id for r in rows} == {0, 20}
    assert [r.vec_id for r in rows if r.query_id == 0] == [1, 20, 8]
    assert multi_index.nearest_neighbours(frame(spark, [])).count() == 0
    assert multi_index.nearest_neighbours(frame(spark, [(20, [1.0, 2.0])])).count() == 0
