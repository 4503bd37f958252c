"""A table of requests: each one gets what it would get alone."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemora.operators import graph as G
from mnemora.operators import signals as S
from mnemora.operators.scope import TenantScope
from mnemora.plans import requests as Q
from mnemora.plans import search as P
from mnemora.plans import tables as T

D = "/root/testdata/sf0.001"
START, ALL = datetime(2024, 1, 1), TenantScope(1, 2)
MEMORY = "memory_id long, org_id int, space_id int, owner_user_id long, visibility string, event_time timestamp, recorded_at timestamp, created_at timestamp, forgotten_at timestamp"


def memories(spark, moments):
    return spark.createDataFrame([(i, 1, 2, 1, "org", t, START, START, None) for i, t in enumerate(moments)], MEMORY)


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_walks_keep_their_own_frontier_cap_and_budget(spark):
    rng = random.Random(11)
    m = memories(spark, [START] * 400)
    edges = [(e, rng.randrange(30), rng.randrange(30), rng.choice([None, 0.2, 0.5, 0.9]), START + timedelta(hours=rng.randrange(200)), rng.choice([None, *range(400)])) for e in range(1500)]
    kinds = "edge_id long, source_id long, target_id long, confidence double, valid_from timestamp, memory_id long"
    e = spark.createDataFrame(edges, kinds).withColumns({"recorded_at": F.col("valid_from"), "forgotten_at": F.lit(None).cast("timestamp"), "org_id": F.lit(1), "space_id": F.lit(2), "visibility": F.lit("org"), "owner_user_id": F.lit(1)})
    links = spark.createDataFrame([(i % 400, 0 if i < 150 else rng.randrange(1, 30)) for i in range(330)], "memory_id long, entity_id long")
    g = G.GraphTables(m, spark.createDataFrame([(i, f"e{i}") for i in range(30)], "entity_id long, name string"), e, links)
    asked = [(0, None, 2, [(3, 1.0), (4, 0.5)]), (1, START + timedelta(hours=60), 2, [(3, 1.0)]), (2, START + timedelta(hours=60), 1, [(7, 0.7), (3, 0.2)]), (3, None, 2, [(0, 0.9)]), (4, None, 0, [(3, 1.0)])]
    seeds = spark.createDataFrame([(q, *s) for q, _, _, seeds in asked for s in seeds], "query_id long, entity_id long, relevance double")
    requests = spark.createDataFrame([a[:3] for a in asked], "query_id long, as_of timestamp, depth int")
    now, want = F.lit(START + timedelta(days=20)), []
    for q, as_of, depth, _ in asked:
        if depth:
            alone = G.graph_signal(g, seeds.where(F.col("query_id") == q).drop("query_id"), ALL, now, as_of and F.lit(as_of), depth)
            want += rows(alone.withColumn("query_id", F.lit(q)), "query_id", "memory_id", "rank", "score")
    assert rows(G.graph_signal_each(g, seeds, requests, ALL, now), "query_id", "memory_id", "rank", "score") == sorted(want)
    hops = G.edges_for_each(G.edge_ends(G.usable_edges(e, ALL)), seeds.join(requests, "query_id"))
    assert hops.groupBy("query_id").count().agg(F.max("count")).first()[0] <= G.EDGES_PER_HOP


def test_windows_find_the_nearest_of_whole_tables(spark):
    rng = random.Random(12)
    moments = [START + timedelta(minutes=rng.randrange(60 * 24 * 90)) for _ in range(900)] + [START + timedelta(days=45)] * 120 + [None] * 3
    m = memories(spark, moments)
    windows = [(0, START, START + timedelta(days=90)), (1, START + timedelta(days=3, hours=5), START + timedelta(days=4)), (2, START + timedelta(days=44), START + timedelta(days=46)), (3, START + timedelta(days=88), START + timedelta(days=400)), (4, START, START), (5, START + timedelta(days=90), START + timedelta(days=1)), (6, None, None), (7, START, START + timedelta(days=90))]
    got = rows(S.temporal_signal_each(m, spark.createDataFrame(windows, "query_id long, start timestamp, end timestamp"), ALL), "query_id", "memory_id", "rank", "score")
    want = [r for q, a, b in windows if a for r in rows(S.temporal_signal(m, ALL, a, b).withColumn("query_id", F.lit(q)), "query_id", "memory_id", "rank", "score")]
    assert got == sorted(want)


def test_names_of_equal_words_stand_for_each_other(spark):
    names = ["red widget", "Red-Widget", "widget", "blue gear", *[f"supplier {i}" for i in range(40)], None, ""]
    e = spark.createDataFrame(list(enumerate(names)), "entity_id long, name string")
    texts = ["the red widget supplier", "supplier 7", "nothing here", "of the", "Gear?"]
    got = rows(G.seeds_by_names(e, spark.createDataFrame([(t,) for t in texts], "query string")), "query", "entity_id", "relevance")
    assert got == sorted(r for t in texts for r in rows(G.seeds_by_name(e, F.lit(t)).withColumn("query", F.lit(t)), "query", "entity_id", "relevance"))


def test_each_request_gets_what_it_gets_alone(spark):
    g, v = T.graph_tables(spark, D), T.table(spark, D, "embeddings")
    vectors = {i: list(map(float, v.where(F.col("vec_id") == i).first().embedding)) for i in (0, 7)}
    asked = [P.SearchRequest("red widget in march 2023", tuple(vectors[0]), limit=4, recency_bias=0.1), P.SearchRequest("is the blue anvil still current", tuple(vectors[7]), limit=6, max_depth=1, diversify=True)]
    table = spark.createDataFrame([(k, r.query, list(r.vector), r.limit, r.recency_bias, r.max_depth, r.diversify) for k, r in enumerate(asked)], "query_id long, query string, embedding array<double>, limit int, recency_bias double, max_depth int, diversify boolean")
    sessions = g.memories.select("memory_id", (F.col("memory_id") % 3).cast("string").alias("session_id"))
    found = P.search_each(g, v, table, T.SCOPE, T.TODAY, None, sessions)
    got = sorted((r.query_id, r.position, r.memory_id, round(r.final, 6)) for r in found.collect())
    want = [(k, r.position, r.memory_id, round(r.final, 6)) for k, request in enumerate(asked) for r in P.search(g, v, request, T.SCOPE, T.TODAY, None, sessions).collect()]
    assert got == sorted(want) and {k for k, *_ in got} == {0, 1}


def test_settings_entitlements_and_answers(spark):
    kinds = "query_id long, org_id int, query string, embedding array<double>, limit int"
    table = spark.createDataFrame([(1, 1, "a", [1.0], None), (2, 2, "b", None, 50), (3, 9, "c", [], 1)], kinds)
    rights = spark.createDataFrame([(1, False, None, None), (2, None, 0, False)], "org_id int, graph_retrieval boolean, max_graph_depth int, cross_encoder_reranking boolean")
    full = P.prepared(table, T.TODAY).join(table.select("query_id", "org_id"), "query_id")
    got = {r.query_id: (r.limit, r.graph, r.max_depth, r.rerank) for r in P.gated(full, rights).collect()}
    assert got == {1: (10, False, 2, True), 2: (50, False, 0, False), 3: (1, True, 2, True)}
    for query, limit in (("", 5), ("x" * 3001, 5), (None, 5), ("x", 51)):
        with pytest.raises(Exception, match="characters|1 to 50"):
            P.prepared(spark.createDataFrame([(1, 1, query, [1.0], limit)], kinds), T.TODAY).collect()
    found = spark.createDataFrame([(1, 5, 2, "x", "fact", 0.5, START, None, 7), (1, 6, 1, "y", "fact", 0.6, START, None, None)], "query_id long, memory_id long, position long, content string, memory_type string, final double, created_at timestamp, event_time timestamp, owner_user_id long")
    out = {r.query_id: [(c.memory_id, c.owner_name) for c in r.candidates] for r in P.responses(table, found, spark.createDataFrame([(7, "Ann")], "user_id long, name string")).collect()}
    assert out == {1: [(6, None), (5, "Ann")], 2: [], 3: []}
    sourced = P.responses(table, found, spark.createDataFrame([], "user_id long, name string"), spark.createDataFrame([(5, "s")], "memory_id long, source string"))
    assert [c.source for c in sourced.where("query_id = 1").first().candidates] == [None, "s"]


def broken(monkeypatch):
    """From now on the keyword signal of the registered queries fails."""
    index = T.keyword_index
    monkeypatch.setattr(T, "keyword_index", lambda spark, sf_dir: index(spark, sf_dir).withColumn("found", F.raise_error(F.lit("down")).cast("binary")))


def test_a_failing_signal_ends_search_requests(spark, monkeypatch):
    broken(monkeypatch)
    with pytest.raises(Exception, match="down"):
        Q.QUERIES["search_requests"](spark, D).collect()


def test_a_failing_signal_ends_search_responses(spark, monkeypatch):
    broken(monkeypatch)
    with pytest.raises(Exception, match="down"):
        Q.QUERIES["search_responses"](spark, D).collect()
