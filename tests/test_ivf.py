"""The inverted-file index: every row in it, recall against the exact way, and the exact way when all cells are probed."""

import numpy as np
from pyspark.sql import functions as F

from mnemora.operators import ivf, knn

SCHEMA = "vec_id long, embedding array<double>"


def vectors(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, 24))
    x = centres[rng.integers(0, 30, n)] + 0.6 * rng.standard_normal((n, 24))
    x[:400] = x[0]  # a hot cell
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] * 24)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_recall_and_completeness(spark):
    v = vectors(spark)
    index = ivf.build(v)
    assert index.rows.count() == 3000 and index.rows.select("vec_id").distinct().count() == 3000
    q = v.where("vec_id % 50 = 0 and vec_id < 9000").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = knn.nearest_batch(v, q, 50, -1.0)
    for rows in (None, 100):
        found = ivf.nearest_probed_batch(index, q, 50, -1.0, rows=rows)
        r = ivf.recall(found, exact).agg(F.sum("hit").alias("hit"), F.sum("wanted").alias("wanted")).first()
        assert r.wanted == 60 * 50 and r.hit >= 0.9 * r.wanted
    one = list(v.where("vec_id = 1000").first().embedding)
    want = [x.vec_id for x in exact.where("query_id = 1000").orderBy("rank").collect()]
    got = [x.vec_id for x in ivf.nearest_probed(index, one, 50, -1.0).orderBy("rank").collect()]
    assert len(set(got) & set(want)) >= 45 and got[0] == 1000


def test_all_cells_probed_is_exact(spark):
    v = vectors(spark, 600, 2)
    index = ivf.build(v, probes=10_000)
    q = v.where("vec_id % 60 = 0 and vec_id < 9000").select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda df: sorted((r.query_id, r.vec_id, r["rank"]) for r in df.collect())
    assert key(ivf.nearest_probed_batch(index, q, 7, 0.2)) == key(knn.nearest_batch(v, q, 7, 0.2))


def test_nothing(spark):
    v = spark.createDataFrame([(1, None)], SCHEMA)
    index = ivf.build(v)
    assert index.rows.isEmpty() and ivf.nearest_probed(index, [1.0], 5).isEmpty()
    q = spark.createDataFrame([(0, [1.0])], "query_id long, embedding array<double>")
    assert ivf.nearest_probed_batch(index, q).isEmpty()
