"""A cell of nearest neighbours: against all pairs, equals included, and what it holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from mnemora.operators import knn


def cell(name, x, **more):
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
    return pa.table({name: pa.array(np.arange(len(x))), "embedding": lists, **more})


def test_best_of_cell_is_that_of_all_pairs():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-1, 2, (3000, 4)).astype(float), rng.integers(-1, 2, (700, 4)).astype(float)  # few directions: many equals
    k, least = rng.integers(1, 9, 700), rng.choice([-1.1, 0.3, 2.0], 700)
    got = knn._best_of_cell(cell("vec_id", x), cell("query_id", q, k=pa.array(k, pa.int32()), min_score=pa.array(least)), "vec_id").to_pandas()
    score = np.round(knn._unit(q) @ knn._unit(x).T, 9)
    found = got.assign(score=got.score.round(9)).groupby("query_id").score.apply(lambda s: sorted(s, reverse=True)).to_dict()
    for i in range(700):
        assert found.get(i, []) == sorted(score[i][score[i] >= least[i]], reverse=True)[: k[i]]


def test_memory_of_a_cell_does_not_grow_with_its_queries():
    rng = np.random.default_rng(1)
    v, peaks = cell("vec_id", rng.normal(size=(4000, 8))), []
    for n in (1000, 6000):
        q = cell("query_id", rng.normal(size=(n, 8)), k=pa.array(np.full(n, 5), pa.int32()), min_score=pa.array(np.full(n, 0.1)))
        tracemalloc.start()
        assert knn._best_of_cell(v, q, "vec_id").num_rows == 5 * n
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 10


def test_requests_of_equal_vectors_ask_once(spark, monkeypatch):
    from types import SimpleNamespace

    from mnemora.plans import search as P

    rows, asked = [(q, [1.0, float(q % 2)] if q < 9 else None) for q in range(10)], []
    requests = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(P, "nearest_batch", lambda v, q: asked.append(q.count()) or knn.nearest_batch(v, q))
    monkeypatch.setattr(P, "active", lambda _: vectors.withColumnRenamed("vec_id", "memory_id"))
    monkeypatch.setattr(P, "scoped", lambda *_: None)
    got = P.signal_plans_each(SimpleNamespace(memories=None), vectors, requests, None, None)["semantic"]().collect()
    assert asked == [2] and sorted((r.query_id, r.memory_id) for r in got) == sorted([(q, 1) for q in range(9)] + [(q, 2) for q in range(1, 9, 2)])
