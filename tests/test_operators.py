import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import graph as G
from mnemora.operators import ingestion as I
from mnemora.operators import knn
from mnemora.operators import lifecycle as C
from mnemora.operators import ranking as R
from mnemora.operators import signals as S
from mnemora.operators import visibility as V
from mnemora.operators.scope import TenantScope, scoped
from mnemora.sources import logs, stores


def test_scope(spark):
    rows = spark.createDataFrame([(1, 1, "org", 5), (1, 1, "private", 5), (1, 1, "private", 6), (1, 2, "org", 5), (1, 1, "private", None)], "org_id int, space_id int, visibility string, owner_user_id long")
    count = lambda visible, kind="memory": scoped(rows, TenantScope(1, 1, visible), kind).count()
    assert (count(None), count(()), count((5,)), count((5,), "graph_edge"), count((), "entity")) == (4, 0, 2, 3, 4)


def greedy(items, k, penalty=0.1):
    """items: (memory, session, final), best first."""
    if len(items) <= k:
        return [m for m, _, _ in items]
    left, used, out = list(items), {}, []
    while left and len(out) < k:
        best = None
        for it in left:
            score = it[2] - penalty * used.get(it[1], 0)
            if best is None or score > best[0]:
                best = (score, it)
        left.remove(best[1])
        used[best[1][1]] = used.get(best[1][1], 0) + 1
        out.append(best[1][0])
    return out


def test_session_diversity_equals_the_greedy_choice(spark):
    rng = random.Random(2)
    rows, want = [], []
    for q in range(40):
        n = rng.randint(1, 25)
        items = sorted(((m, rng.choice([None, 1, 2, 3]), rng.randint(0, 20) / 20) for m in range(n)), key=lambda x: -x[2])
        rows += [(q, m, s, f, place) for place, (m, s, f) in enumerate(items)]
        want += [(q, p, m) for p, m in enumerate(greedy([(m, s if s else f"m{m}", f) for m, s, f in items], 6), 1)]
    df = spark.createDataFrame(rows, "query_id int, memory_id long, session_id long, final double, place long")
    got = R.session_diverse(df, 6, by=["query_id"]).select("query_id", "position", "memory_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mmr_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    vec = {i: rng.standard_normal(6) for i in range(20)}
    final = {i: float(rng.integers(1, 30)) / 30 for i in range(24)}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    left, picked, top = sorted(final, key=lambda i: (-final[i], i)), [], max(final.values())
    while left and len(picked) < 8:
        best = None
        for i in left:
            if final[i] / top < 0.3:
                continue
            near = max([0.0, *(cos(vec[i], vec[j]) for j in picked if j in vec)]) if i in vec else 0.0
            score = 0.6 * final[i] / top - 0.4 * near
            if best is None or score > best[0]:
                best = (score, i)
        if best is None:
            break
        picked.append(best[1])
        left.remove(best[1])
    df = spark.createDataFrame([(1, i, f) for i, f in final.items()], "query_id long, memory_id long, final double")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "vec_id long, embedding array<double>")
    assert [r.memory_id for r in R.mmr(df, vectors, 8).orderBy("position").collect()] == picked


def test_rrf_ties_and_remap(spark):
    a = spark.createDataFrame([(7, 1), (8, 2)], "memory_id long, rank long")
    b = spark.createDataFrame([(8, 1), (7, 2), (9, 3)], "memory_id long, rank long")
    fused = R.rank_remap(R.rrf(R.tagged({"semantic": a, "keyword": b}))).orderBy("place").collect()
    assert [r.memory_id for r in fused] == [7, 8, 9]
    assert fused[0].fused == pytest.approx(1 / 61 + 1 / 62) and [r.base for r in fused] == pytest.approx([1, 0.55, 0.1])


def test_floor_and_fail_open(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.1)], "memory_id long, base double")
    assert R.relevance_floor(df, "rerank-2.5").count() == 1 and R.relevance_floor(df, None).count() == 2
    assert R.in_range_if_any(df, F.col("base") > 0.3).count() == 1 and R.in_range_if_any(df, F.col("base") > 3).count() == 2


def test_keyword_syntax():
    assert S.parse_query('red fox "two words" or hen -"bad one" -cat') == {"must": [[["red"]], [["fox"]], [["two", "words"], ["hen"]]], "banned": [["bad", "one"], ["cat"]]}


def test_keyword_signal(spark):
    texts = ["red foxes run", "red fox", "the red hen", "fox red bad one", "blue"]
    m = spark.createDataFrame([(i, t, 1, 1, "org", 1, None) for i, t in enumerate(texts)], "memory_id long, content string, org_id int, space_id int, visibility string, owner_user_id long, forgotten_at timestamp")
    rows = S.keyword_signal(m, 'fox red -"bad one"', TenantScope(1, 1)).collect()
    assert [r.memory_id for r in rows] == [1, 0] and rows[0].score == 1.0
    assert {r.memory_id for r in S.keyword_signal(m, "red or blue", TenantScope(1, 1)).collect()} == {0, 1, 2, 3, 4}
    assert S.keyword_signal(m, "  ", TenantScope(1, 1)).count() == 0


def test_nearest_batch(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 5))
    x[7] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(90, None), (91, [])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, x[0].tolist(), 3, 0.0), (1, x[1].tolist(), 0, 0.0), (2, [], 5, 0.0), (3, x[3].tolist(), 50, 0.5)], "query_id long, embedding array<double>, k int, min_score double")
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    want = []
    for i, k, least in ((0, 3, 0.0), (3, 50, 0.5)):
        score = unit @ unit[i]
        order = sorted((j for j in range(50) if score[j] >= least), key=lambda j: (-score[j], j))[:k]
        want += [(i, j, r) for r, j in enumerate(order, 1)]
    for rows in (None, 2, 20):
        got = knn.nearest_batch(v, q, rows=rows).select("query_id", "vec_id", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_turns_and_windows(spark):
    text = "intro line\nUser: hello \nmore\n\nASSISTANT: hi\nuser: x\nsystem: y\ntool:z"
    s = spark.createDataFrame([(1, text, "conversation", None), (2, "just text", "text", None), (3, "a: b", "pdf", None), (4, "one\ntwo", "text", "s1")], "source_id long, content string, content_type string, session_id string")
    turns = [r.content for r in I.turns_of(s.where("source_id = 1")).orderBy("turn").collect()]
    assert turns == ["intro line", "user: hello\nmore", "assistant: hi", "user: x", "system: y", "tool: z"]
    rows = {(r.source_id, r.sequence): r for r in I.chunk_sources(s).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (4, 0)}
    assert rows[1, 1].content == "system: y\ntool: z" and rows[1, 1].context == rows[1, 0].content and rows[1, 0].context is None
    assert rows[2, 0].chunker == "recursive" and rows[4, 0].chunker == "conversation"


@pytest.mark.parametrize(("args", "want"), [((10, 0, 8), (0, 8, 2)), ((10, 8, 8), (8, 10, 0)), ((10, 99, 8), (10, 10, 0)), ((10, -3, 4), (0, 4, 6)), ((10, 2, 0), (2, 2, 8))])
def test_batch_plan(args, want):
    assert I.plan_batch(*args) == want


def test_grant_errors(spark):
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "user_id long, group_id long")
    grants = spark.createDataFrame([(1, 2), (2, 3)], "viewer_group long, subject_group long")
    for pair in ((1, 1), (1, 2), (3, 1)):
        with pytest.raises(V.GrantError):
            V.grant_impact(members, grants, *pair)
    assert {r.user_id for r in V.visible_users(members, grants, 1).collect()} == {1, 2, 3}
    assert {r.user_id for r in V.visible_users(members, grants, 1, enabled=False).collect()} == {1}


def test_walk_equals_a_plain_loop(spark):
    rng = random.Random(4)
    import math

    edges = [(i, rng.randrange(12), rng.randrange(12), rng.choice([None, 0.1, 0.3, 0.8]), rng.choice([None, rng.randrange(40)])) for i in range(40)]
    seeds = {0: 1.0, 3: 0.5}
    ok = [e for e in edges if (1.0 if e[3] is None else e[3]) >= 0.3]
    scores = {50: 1.0}
    frontier, visited = dict(seeds), set(seeds)
    for depth in (1, 2):
        nxt = {}
        for _, s, t, c, m in ok:
            if s in frontier:
                rel, other = frontier[s], t
            elif t in frontier:
                rel, other = frontier[t], s
            else:
                continue
            score = (1.0 if c is None else c) * math.exp(-0.5 * depth) * rel
            if m is not None:
                scores[m] = max(scores.get(m, 0), score)
            if other not in visited:
                nxt[other] = max(nxt.get(other, 0), score)
        visited |= set(nxt)
        frontier = nxt
    e = spark.createDataFrame(edges, "edge_id long, source_id long, target_id long, confidence double, memory_id long").selectExpr("*", "timestamp'2024-01-01' as recorded_at", "cast(null as timestamp) as valid_from", "cast(null as timestamp) as forgotten_at", "1 as org_id", "1 as space_id", "'org' as visibility", "1L as owner_user_id")
    m = spark.range(60).selectExpr("id as memory_id", "1 as org_id", "1 as space_id", "'org' as visibility", "1L as owner_user_id", "cast(null as timestamp) as forgotten_at")
    g = G.GraphTables(m, None, e, spark.createDataFrame([(50, 0)], "memory_id long, entity_id long"))
    s = spark.createDataFrame(list(seeds.items()), "entity_id long, relevance double")
    got = {r.memory_id: r.score for r in G.walk(g, s, TenantScope(1, 1), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == pytest.approx(scores)


def test_guarded_state_changes(spark):
    t = spark.createDataFrame([(1, "pending"), (2, "done"), (3, "pending")], "id long, status string")
    c = spark.createDataFrame([(1, "running"), (2, "running")], "id long, to string")
    assert {r.id: r.status for r in C.where_state(t, c, "id", "pending").collect()} == {1: "running", 2: "done", 3: "pending"}
    assert C.insert_if_absent(t, spark.createDataFrame([(3, "x"), (4, "y"), (4, "y")], t.schema), ["id"]).count() == 4


def test_fuzzy_resolution(spark):
    names = spark.createDataFrame([("acme corp", "Acme Corp"), ("corp acme", "Corp Acme"), ("zz", "ZZ"), ("brand new", "Brand New")], "key string, name string")
    entities = spark.createDataFrame([(1, "Acme Corp"), (2, "Other"), (3, "zz top")], "entity_id long, name string")
    got = {r.key: (r.how, r.entity_id) for r in I.resolve_entities(names, entities, I.entity_pool(names, entities)).collect()}
    assert got["acme corp"] == ("exact", 1) and got["corp acme"] == ("fuzzy", 1) and got["zz"][0] == got["brand new"][0] == "new"


def test_log_archive(spark, tmp_path):
    import gzip

    for day, lines in (("20240101", ['{"level":"ERROR","a":1}', "not json"]), ("20240103", ['{"level":"info","b":{"c":2}}'])):
        (tmp_path / day).mkdir()
        with gzip.open(tmp_path / day / "x.json.gz", "wt") as f:
            f.write("\n".join(lines))
    records = logs.scan_archive(spark, f"file://{tmp_path}", "2024-01-01", "2024-01-03")
    assert records.count() == 3 and {r.day for r in records.collect()} == {"20240101", "20240103"}
    found = logs.fields(logs.search(records, {"LEVEL": "error"}), ["level", "gone"]).collect()
    assert [(r.level, r.gone) for r in found] == [("ERROR", None)]
    with pytest.raises(ValueError):
        logs.archive_paths("x", "2024-01-01", "2024-12-31")
    with pytest.raises(ValueError):
        logs.search(records, [])


def test_report_and_ports(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>"), (2, None)], "id long, t string")
    assert "<td>&lt;b&gt;</td>" in stores.html_report(df, "x")
    stores.write_csv(df, f"{tmp_path}/csv")
    stores.write_json(df, f"{tmp_path}/json")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == spark.read.json(f"{tmp_path}/json").count() == 2
    score = df.select(stores.LexicalReranker().score(F.lit("red fox"), F.lit("the Red hen")).alias("s")).first().s
    assert score == 0.5
    with pytest.raises(ValueError):
        stores.metric_rows(df, "m", ["t"] * 21, [], F.col("id"))


def test_grant_closure_equals_brute_force(spark):
    rng = random.Random(5)
    grants = {(a, b) for a, b in itertools.combinations(range(10), 2) if rng.random() < 0.2}
    reach = {a: {a} for a in range(10)}
    for _ in range(10):
        for a, b in grants:
            for s in reach.values():
                if a in s:
                    s.add(b)
    start = spark.range(10).selectExpr("id as root", "id as group_id")
    got = V.reachable(spark.createDataFrame(sorted(grants), "viewer_group long, subject_group long"), start).collect()
    assert {(r.root, r.group_id) for r in got} == {(a, b) for a, s in reach.items() for b in s}


def test_fixtures_replay_what_was_recorded(spark, tmp_path):
    import json

    from mnemora.sources import stores

    key = stores.fixture_key("embed", ["text", {"size": 4}])
    assert key == stores.fixture_key("embed", ["text", {"size": 4}]) != stores.fixture_key("embed", ["text", {"size": 5}])
    (tmp_path / "f.json").write_text(json.dumps({"note": "n", "entries": {key: {"request": ["text"], "response": {"v": [1, 2]}}}}, indent=1))
    recorded = stores.fixtures(spark, str(tmp_path / "f.json"))
    assert [tuple(r) for r in recorded.collect()] == [(key, "embed", '["text"]', '{"v":[1,2]}')]
    asked = spark.createDataFrame([(key, 1)], "key string, n int")
    assert [(r.n, r.response) for r in stores.replayed(asked, recorded).collect()] == [(1, '{"v":[1,2]}')]
    with pytest.raises(Exception, match="no fixture for embed:none"):
        stores.replayed(spark.createDataFrame([("embed:none", 1)], "key string, n int"), recorded).collect()


def test_a_failing_signal_counts_as_empty_unless_it_is_needed(spark):
    from pyspark.sql import functions as F

    from mnemora.plans.search import answered

    good = lambda: spark.createDataFrame([(1, 1, 0.5)], "memory_id long, rank long, score double")
    bad = lambda: good().withColumn("rank", F.raise_error(F.lit("down")).cast("long"))
    got = answered({"semantic": good, "keyword": bad}).collect()
    assert [(r.signal, r.memory_id) for r in got] == [("semantic", 1)]
    with pytest.raises(Exception, match="down"):
        answered({"semantic": bad, "keyword": good})
