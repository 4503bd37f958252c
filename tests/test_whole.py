"""Jobs that once did less than the whole: against brute force."""

import itertools
import random

from mnemora import catalog
from mnemora.functions.fuzzy import token_sort_ratio
from mnemora.operators import ingestion as I
from mnemora.operators import visibility as V

D = "/root/testdata/sf0.1"


def test_visible_counts_equal_the_pairs_and_make_none(spark):
    rng = random.Random(3)
    rows = [(u, g) for u in range(40) for g in rng.sample(range(8), rng.randint(1, 3))] + [(50, None)]
    members = spark.createDataFrame(rows, "user_id long, group_id long")
    grants = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.2], "viewer_group long, subject_group long")
    want = {}
    for r in V.visible_pairs(members, grants).collect():
        want[r.viewer] = want.get(r.viewer, 0) + 1
    assert {r.viewer: r.users for r in V.visible_counts(members, grants).collect()} == want


def test_visible_counts_of_a_large_group(spark):
    members = spark.range(300_000).selectExpr("id as user_id", "id % 2 as group_id")
    grants = spark.createDataFrame([(0, 1)], "viewer_group long, subject_group long")
    got = V.visible_counts(members, grants).groupBy("users").count().collect()
    assert sorted(map(tuple, got)) == [(150_000, 150_000), (300_000, 150_000)]


def test_name_similarity_rates_all_suppliers(spark):
    assert catalog.QUERIES["name_similarity"](spark, D).count() == spark.read.parquet(f"{D}/supplier.parquet").count()


def test_fuzzy_resolution_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["red", "blue", "widget", "widgets", "gear", "gears", "bolt", "anvil", "a", "münz", "of"]
    some = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)}

    def typo(t):
        k = rng.randrange(len(t))
        return rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice("xyz") + t[k:], t[:k] + "q" + t[k + 1 :]])

    entities = [(1, "red widget"), (2, "widgets blue"), *enumerate(sorted(some - {"red widgets"}), 10)]
    names = {"red widgets"} | {typo(t) for t in some} | {" ".join(reversed(t.split())) + "s" for t in some}
    names = sorted({n.lower() for n in names} - {n for _, n in entities})
    e = spark.createDataFrame(entities, "entity_id long, name string")
    n = spark.createDataFrame([(t, t) for t in names], "key string, name string")
    got = {r.key: r.entity_id for r in I.resolve_entities(n, e, I.similar_name_pool(n, e)).where("how = 'fuzzy'").collect()}
    best = {t: min((-token_sort_ratio(t, name), i) for i, name in entities) for t in names if len(t) >= I.MIN_FUZZY}
    assert got == {t: i for t, (ratio, i) in best.items() if -ratio >= I.RESOLVE_SCORE}
    assert got["red widgets"] == 1
