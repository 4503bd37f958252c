"""The sparse cosine join against all pairs."""

import math
import random
from collections import Counter

import pytest

from mnemora.operators import ingestion as I
from mnemora.operators.names import similar_names


def grams(name):
    f = f" {' '.join(name.lower().split())} "
    return Counter(f[i : i + 3] for i in range(len(f) - 2)) if f.strip() else Counter()


def plain(names, entities, least, k):
    real = [(i, grams(n)) for i, n in entities if n and grams(n)]
    df = Counter(g for _, c in real for g in c)
    weigh = lambda c: {g: n * math.log1p(len(real) / df.get(g, 1)) for g, n in c.items()}
    unit = lambda w: {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()}
    right = [(i, unit(weigh(c))) for i, c in real]
    out = {}
    for key, name in names:
        if not name or not grams(name):
            continue
        own = unit(weigh(grams(name)))
        rated = [(round(sum(x * w.get(g, 0) for g, x in own.items()), 9), i) for i, w in right]
        for c, i in sorted(((c, i) for c, i in rated if c >= least), key=lambda x: (-x[0], x[1]))[:k]:
            out[key, i] = c
    return out


@pytest.mark.parametrize("least,k", [(0.5, 50), (0.2, 3), (0.8, 50)])
def test_all_pairs_above_the_threshold(spark, least, k):
    rng = random.Random(7)
    words = ["red", "blue", "widget", "widgets", "supplier", "north", "acme", "é", "x"]
    name = lambda: rng.choice(["", " "]) + " ".join(rng.choice(words) + rng.choice(["", "s", "#1"]) for _ in range(rng.randint(1, 4)))
    entities = [(i, name()) for i in range(120)] + [(500 + i, "Same  Name") for i in range(60)] + [(900, None), (901, ""), (902, "  ")]
    names = [(f"n{i}", name()) for i in range(40)] + [("same", "same name"), ("none", None), ("empty", ""), ("far", "zzzz qqqq")]
    got = similar_names(spark.createDataFrame(names, "key string, name string"), spark.createDataFrame(entities, "entity_id long, name string"), least, k)
    assert {(r.key, r.entity_id): round(r.cosine, 6) for r in got.collect()} == {p: round(c, 6) for p, c in plain(names, entities, least, k).items()}


def test_pool_is_the_union(spark):
    names = spark.createDataFrame([("red widget", "red widget")], "key string, name string")
    entities = spark.createDataFrame([(1, "widget red"), (2, "red widgets"), (3, "red widget set"), (4, "blue")], "entity_id long, name string")
    assert {r.entity_id for r in I.entity_pool(names, entities).collect()} == {1, 2, 3}
