import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from mnemora.llm import vector_dedup as V
from mnemora.llm.common import groups
from mnemora.llm.vector_dedup import near_duplicate_vectors
from tests.llm.cases import Groups, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, raw string"


def make(seed, n=150, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(8)] + rng.standard_normal(dims) * rng.choice([0.0, 0.02, 0.1, 0.15, 1.0])
        rows.append((i, [float(x) for x in (v * rng.choice([1, 1, 3])).astype(np.float32)], int(rng.integers(2)), "c", "r"))
    rows += [(n, None, 1, "", ""), (n + 1, [0.0] * dims, 1, "", ""), (n + 2, [math.nan] * dims, 1, "", ""), (n + 3, [None] + [1.0] * (dims - 1), 1, "", ""), (n + 4, rows[0][1], None, "", ""), (n + 5, [1.0, 2.0], 1, "", ""), (n + 6, [2.0, 4.0], 1, "", ""), (n + 7, [], 0, "", ""), (n + 8, [math.inf] * dims, 0, "", "")]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows):
    good = {}
    for i, v, label, *_ in rows:
        ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good[i] = (np.array(v, dtype=float), label) if ok else None
    groups, links = Groups(good), dict.fromkeys(good, 0)
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if x and y and x[1] == y[1] and len(x[0]) == len(y[0]) and x[0] @ y[0] / (np.linalg.norm(x[0]) * np.linalg.norm(y[0])) >= 0.98:
            groups.join(a, b)
            links[a] += 1
            links[b] += 1
    return sorted((i, links[i], groups.find(i), groups.find(i) == i) for i in good)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 2048), (2, 7)])
def test_equals_brute_force(spark, seed, chunk):
    rows = make(seed)
    got = rows_of(near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), chunk=chunk), "vec_id", "n_links", "component_id", "kept")
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 100


def test_bench_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in v.select("vec_id", "embedding", "label").collect()]
    assert rows_of(near_duplicate_vectors(v), "vec_id", "n_links", "component_id", "kept") == brute(rows)


def test_empty(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_go_on_over_whole_batches():
    rows = [("a", 1)] * 5 + [("a", 2)] * 9 + [("b", 2)] * 4 + [("c", 3)]
    for size in (1, 2, 3, 5, 30):
        table = pa.table([pa.array([r[k] for r in rows]) for k in (0, 1)] + [pa.array(range(len(rows)))], names=["x", "y", "no"])
        got = [g.column(2).to_pylist() for g in groups(iter(table.to_batches(max_chunksize=size)), 2)]
        assert got == [list(range(5)), list(range(5, 14)), list(range(14, 18)), [18]]


def test_cells_larger_than_a_batch(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in (centre + 0.05 * rng.standard_normal(16)).astype(np.float32)], 1, "c", "r") for i in range(90)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = rows_of(near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)), "vec_id", "n_links", "component_id", "kept")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_links_come_a_bounded_number_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal(16) + 0.08 * rng.standard_normal((60, 16))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if unit[i] @ unit[j] >= 0.98}
    monkeypatch.setattr(V, "VERIFIED", 16 * 10)
    found = [list(zip(u.tolist(), v.tolist(), strict=True)) for b in range(V.BLOCKS) for u, v in V.compare(b, 16, [r.tobytes() for r in x], np.ones(60, bool), np.zeros(60, int), 0, 0, 0.98)]
    assert max(map(len, found)) <= 10
    pairs = [tuple(sorted(p)) for part in found for p in part]
    assert len(pairs) == len(set(pairs)) > 100 and set(pairs) == want
