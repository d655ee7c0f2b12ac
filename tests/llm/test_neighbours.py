import numpy as np
import pytest

from tessera.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k, every):
    """Each row whose id `every` divides, against every other row; rows with one id in turn by rank."""
    found = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.zeros(len(ids))
        for d in range(x.shape[1]):
            score += x[i, d] * x[:, d]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        found.setdefault(int(ids[i]), []).append([(int(ids[j]), float(score[j])) for j in order])
    return {q: [x for rank in zip(*lists) for x in sorted(rank)] for q, lists in found.items()}


def searched(spark, rows, **more):
    out = {}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), **more).orderBy("query_id", "rank", "vec_id", "score").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_table_is_exact_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:120] = x[40]  # copies
    x[7] = 3 * x[8]
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(300)]
    odd = [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0, None] + [0.0] * 6, 0), (304, [float("inf")] + [0.0] * 7, 0), (305, [1.0], 0), (None, [1.0] * 8, 0), (320, [0.0] * 8, 0)]
    # Ids that several rows have: with equal vectors and with others.
    ids = np.array([*range(300), 0, 1, 0, 60, 2])
    y = np.concatenate((x, x[[0, 1, 17, 40, 40]])).astype(np.float64)
    again = [(int(k), [float(v) for v in y[n]], 0) for n, k in enumerate(ids) if n >= 300]
    assert searched(spark, rows + odd + again) == brute(ids, y, 20, 20)


def test_double_components_stay_double(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 4)) + np.array([1e6, 0, 0, 0])  # differences that floats don't hold
    docs = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(120)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(docs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(np.arange(120), x, 20, 20)


def test_fewer_candidates_than_k(spark):
    out = searched(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (20, [1.0, 0.0], 0)])
    assert [v for v, _ in out[0]] == [20, 1] and [v for v, _ in out[20]] == [0, 1]
    assert searched(spark, [(0, [1.0], 0)]) == {} and searched(spark, []) == {}


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 6000)] + 0.7 * rng.normal(size=(6000, 24))).astype(np.float32)
    x = x * rng.uniform(0.5, 2, (6000, 1)).astype(np.float32) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    got = searched(spark, [(k, [float(v) for v in x[k]], 0) for k in range(6000)])
    want = brute(np.arange(6000), x.astype(np.float64), 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9, recall


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(3)
    means = rng.normal(size=(1500, 16))
    index, points = neighbours.Centroids(means, 10.0), rng.normal(size=(200, 16))
    found, d = index.search(points, 10)
    exact = np.argsort(((points[:, None] - means[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, exact)]) > 0.9 and (np.diff(d, axis=1) >= 0).all()
