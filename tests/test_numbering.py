"""Numbering within keys: every place once, in order, whatever the key's size."""

import random

from pyspark.sql import functions as F

from mnemora.operators.metrics import latency_summary, upper_median
from mnemora.operators.numbering import numbered_within, running_within
from mnemora.sources.scratch import written


def test_places_of_large_small_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"k{rng.randrange(300)}"]), rng.choice([None, rng.randrange(10**6)]), i, "x", 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v long, id long, at string, index_ int").repartition(7)
    got = numbered_within(df, ["k"], ["v", "id"]).collect()
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        here = sorted((g for g in got if g.k == key), key=lambda g: g["index"])
        assert [g.id for g in here] == [r[2] for r in mine]
        assert [g["index"] for g in here] == list(range(len(mine)))
        assert {g["size"] for g in here} == {len(mine)}


def test_one_key_spans_many_tasks(spark):
    saved = []

    def save(df, name):
        saved.append(written(df, name))
        return saved[-1]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbered_within(spark.range(40_000).selectExpr("'one' as k", "id"), ["k"], ["id"], save=save)
        assert out.where("index <> id or size <> 40000").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["n"] for r in saved[0].groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) < 20_000


def test_nothing(spark):
    assert numbered_within(spark.range(0).selectExpr("1 as k", "id"), ["k"], ["id"]).isEmpty()


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", None, "b"]), i, rng.randrange(5)) for i in range(3000)]
    got = running_within(spark.createDataFrame(rows, "k string, id long, w int").repartition(6), ["k"], ["id"], "w").collect()
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        want, total = [], 0
        for r in mine:
            total += r[2]
            want.append((r[1], total))
        here = sorted((g.id, g.run) for g in got if g.k == key)
        assert here == want and {g.total for g in got if g.k == key} == {total}


def test_order_statistics_of_a_key_of_a_million_values(spark):
    big = spark.range(1_000_000).selectExpr("'big' as k", "cast(id * 7919 % 1000003 as double) as value")
    small = spark.createDataFrame([("small", 3.0), ("small", 1.0), ("small", None), (None, 5.0), ("none", None)], "k string, value double")
    got = {r.k: r for r in latency_summary(big.unionByName(small), ["k"]).collect()}
    values = sorted(i * 7919 % 1000003 for i in range(1_000_000))
    assert (got["big"].p50, got["big"].p95, got["big"].n) == (values[499_999], values[949_999], 1_000_000)
    assert abs(got["big"].p90_linear - (values[899_999] + 0.1 * (values[900_000] - values[899_999]))) < 1e-6
    assert (got["small"].p50, got["small"].p95, got["small"].n, round(got["small"].p90_linear, 9)) == (1.0, 3.0, 3, 2.8)
    assert got[None].p50 == 5.0 and got["none"].p50 is None and got["none"].n == 1
    median = {r.k: r.upper_median for r in upper_median(big.unionByName(small), ["k"], "value").collect()}
    assert median == {"big": values[500_000], "small": 3.0, None: 5.0}
