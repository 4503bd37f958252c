"""Registered queries: the knowledge graph, provenance and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.operators import graph as G
from mnemora.operators import listing as L
from mnemora.operators import visibility as V
from mnemora.plans import tables as T

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


SEEDS = [(1000000001, 1.0), (1000000002, 0.5), (3, 0.25)]
SEEDS_SQL = "seeds as (select * from (values (1000000001::bigint, 1.0::double), (1000000002, 0.5), (3, 0.25)) t(entity_id, relevance))"


def _hop_sql(n: int, frontier: str) -> str:
    rec = f"case when coalesce(valid_from, recorded_at) is null then 1.0 else greatest(0.5, least(1, 1 - greatest(0, (epoch(timestamp '{T.GRAPH_NOW}') - epoch(coalesce(valid_from, recorded_at))) / 86400.0) / 365)) end"
    return f"""hop{n}_all as (select u.*, case when s.entity_id is not null then s.relevance else t.relevance end as relevance, case when s.entity_id is not null then u.target_id else u.source_id end as other
  from usable u left join {frontier} s on s.entity_id = u.source_id left join {frontier} t on t.entity_id = u.target_id where s.entity_id is not null or t.entity_id is not null order by since desc, edge_id desc limit 200),
hop{n} as (select *, coalesce(confidence, 1) * exp(-0.5 * {n}) * relevance * {rec} as score from hop{n}_all)"""


WALK = [
    T.MEMORIES, T.EDGES, T.MEMORY_ENTITIES, SEEDS_SQL, _hop_sql(1, "seeds"),
    "front1 as (select other as entity_id, max(score) as relevance from hop1 where other not in (select entity_id from seeds) group by 1)",
    _hop_sql(2, "front1"),
    "links as (select me.memory_id, max(relevance) as score from memory_entities me join seeds using (entity_id) join seen using (memory_id) group by 1)",
    "few as (select count(*) < 100 as ok from links)",
    "after1 as (select memory_id, max(score) as score from (select * from links union all select memory_id, score from hop1, few where ok and memory_id is not null and score > 0) group by 1)",
    "few1 as (select count(*) < 100 as ok from after1)",
    "walked as (select memory_id, max(score) as score from (select * from after1 union all select memory_id, score from hop2, few1, few where few1.ok and few.ok and memory_id is not null and score > 0) group by 1)",
    "best as (select w.* from walked w join seen using (memory_id) order by score desc, memory_id limit 50)",
]
base = T.oracle(*WALK)
edges_only = T.oracle(T.EDGES)
nodes = T.oracle(T.EDGES, T.ENTITIES)
origin = T.oracle(T.MEMORIES, T.SOURCES, T.CHUNKS, T.CHUNK_MEMORIES)


def _seeds(spark):
    return spark.createDataFrame(SEEDS, "entity_id long, relevance double")


def _usable(spark, sf_dir):
    return G.usable_edges(T.edges(spark, sf_dir), T.SCOPE, T.at(T.AS_OF))


@query("graph_edges_for_frontier", base("select edge_id, source_id, target_id, other, round(relevance, 6) as relevance, row_number() over (order by since desc, edge_id desc) as ordinal from hop1_all"))
def graph_edges_for_frontier(spark, sf_dir):
    out = G.edges_for(_usable(spark, sf_dir), _seeds(spark))
    return out.select("edge_id", "source_id", "target_id", "other", F.round("relevance", 6).alias("relevance"), "ordinal")


@query("graph_walk_scores", base("select memory_id, round(score, 9) as score from walked"))
def graph_walk_scores(spark, sf_dir):
    return G.walk(T.graph_tables(spark, sf_dir), _seeds(spark), T.SCOPE, T.at(T.GRAPH_NOW), T.at(T.AS_OF)).withColumn("score", F.round("score", 9))


@query("graph_signal", base("select memory_id, row_number() over (order by score desc, memory_id) as rank, round(score / max(score) over (), 6) as score from best"))
def graph_signal(spark, sf_dir):
    out = G.graph_signal(T.graph_tables(spark, sf_dir), _seeds(spark), T.SCOPE, T.at(T.GRAPH_NOW), T.at(T.AS_OF))
    return out.withColumn("score", F.round("score", 6))


@query("graph_seeds", T.oracle(T.MEMORIES, T.MEMORY_ENTITIES, T.ENTITIES, "asked as (select 'red widget supplier' as key)", T.ALIKE)(r"""select entity_id, round(max(relevance), 6) as relevance from (
  select me.entity_id, score as relevance from (select e.vec_id as memory_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where list_cosine_similarity(e.embedding::double[], q.embedding::double[]) >= 0.2 order by score desc, memory_id limit 5) n join seen using (memory_id) join memory_entities me using (memory_id)
  union all select entity_id, share / max(share) over () from (select entity_id, len(list_intersect(list_distinct(string_split_regex(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+')), ['red', 'widget', 'supplier'])) / 3.0 as share from entities where len(list_intersect(list_distinct(string_split_regex(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+')), ['red', 'widget', 'supplier'])) > 0 order by share desc, entity_id limit 5)
  union all select * from (select entity_id, cosine from alike where key = 'red widget supplier' and cosine >= 0.2 order by round(cosine, 9) desc, entity_id limit 5)) group by 1 order by max(relevance) desc, entity_id limit 10"""))
def graph_seeds(spark, sf_dir):
    from mnemora.operators.knn import nearest

    g, v = T.graph_tables(spark, sf_dir), T.table(spark, sf_dir, "embeddings")
    q = list(v.where("vec_id = 0").first().embedding)
    matches = nearest(v, q, G.SEEDS_EACH, 0.2).select(F.col("vec_id").alias("memory_id"), "score")
    seeds = G.top_seeds(G.seeds_by_memory(g, matches, T.SCOPE), G.seeds_by_name(g.entities, F.lit("red widget supplier")), G.seeds_by_likeness(g.entities, "red widget supplier"))
    return seeds.withColumn("relevance", F.round("relevance", 6))


@query("graph_viewport", nodes("""select entity_id, name, degree from entities join (select id as entity_id, count(*) as degree from (select source_id as id from usable union all select target_id from usable) group by 1) using (entity_id) order by degree desc, entity_id limit 40 offset 10"""))
def graph_viewport(spark, sf_dir):
    return G.viewport(T.entities(spark, sf_dir), _usable(spark, sf_dir), 40, 10)[0].select("entity_id", "name", "degree")


@query("graph_viewport_edges", nodes("""select edge_id from usable where source_id in (select entity_id from page) or target_id in (select entity_id from page) order by coalesce(confidence, 1) desc, edge_id limit 120""").replace("\nselect edge_id", ",\npage as (select entity_id from entities join (select id as entity_id, count(*) as degree from (select source_id as id from usable union all select target_id from usable) group by 1) using (entity_id) order by degree desc, entity_id limit 40 offset 10)\nselect edge_id"))
def graph_viewport_edges(spark, sf_dir):
    return G.viewport(T.entities(spark, sf_dir), _usable(spark, sf_dir), 40, 10)[1].select("edge_id")


@query("graph_stats_types", nodes("select coalesce(entity_type, 'unknown') as entity_type, count(*) as n from entities group by 1"))
def graph_stats_types(spark, sf_dir):
    return G.type_counts(T.entities(spark, sf_dir))


@query("graph_stats_relations", edges_only("select relation_type, count(*) as n from usable group by 1"))
def graph_stats_relations(spark, sf_dir):
    return G.relation_histogram(_usable(spark, sf_dir))


@query("entity_degrees", nodes("select e.entity_id, coalesce(degree, 0) as degree from entities e left join (select id as entity_id, count(*) as degree from (select source_id as id from usable union all select target_id from usable) group by 1) using (entity_id)"))
def entity_degrees(spark, sf_dir):
    e = T.entities(spark, sf_dir).select("entity_id")
    return e.join(G.degrees(_usable(spark, sf_dir)), "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


@query("nodes_with_visible_edge", nodes("select entity_id from entities where entity_id in (select source_id from usable union all select target_id from usable)"))
def nodes_with_visible_edge(spark, sf_dir):
    return G.with_visible_edge(T.entities(spark, sf_dir), _usable(spark, sf_dir)).select("entity_id")


@query("latest_edge_versions", edges_only("select edge_id from (select edge_id, row_number() over (partition by source_id, relation_type, target_id order by since desc, edge_id desc) as n from usable) where n = 1"))
def latest_edge_versions(spark, sf_dir):
    return G.latest_version(_usable(spark, sf_dir)).select("edge_id")


@query("entity_list", nodes("select entity_id, name from entities where name ilike '%red%' and entity_type = 'object' order by name, entity_id limit 30"))
def entity_list(spark, sf_dir):
    return L.list_entities(T.entities(spark, sf_dir), q="red", entity_type="object", limit=30).select("entity_id", "name")


@query("entity_detail", T.oracle(T.MEMORIES, T.MEMORY_ENTITIES)("select memory_id, epoch(created_at)::bigint as created from seen where memory_id in (select memory_id from memory_entities where entity_id = 1000000002) order by created_at desc, memory_id desc limit 10"))
def entity_detail(spark, sf_dir):
    return G.entity_detail(T.graph_tables(spark, sf_dir), 1000000002, T.SCOPE).select("memory_id", F.unix_timestamp("created_at").alias("created"))


@query("entity_memory_links", T.oracle(T.MEMORIES, T.MEMORY_ENTITIES)("select entity_id, memory_id from memory_entities join seen using (memory_id) where entity_id in (1000000001, 1000000002, 2000000005)"))
def entity_memory_links(spark, sf_dir):
    ids = spark.createDataFrame([(1000000001,), (1000000002,), (2000000005,)], "entity_id long")
    return G.memories_of_entities(T.graph_tables(spark, sf_dir), ids, T.SCOPE)


@query("linked_entities", T.oracle(T.MEMORIES, T.MEMORY_ENTITIES, T.ENTITIES)("select entity_id from entities where entity_id in (select entity_id from memory_entities join seen using (memory_id))"))
def linked_entities(spark, sf_dir):
    g = T.graph_tables(spark, sf_dir)
    return G.linked_to_visible(g, g.entities, T.SCOPE).select("entity_id")


@query("provenance_first_source", origin("select memory_id, source_id, sequence, session_id from (select cm.memory_id, c.source_id, c.sequence, s.session_id, row_number() over (partition by cm.memory_id order by c.source_id, c.sequence) as n from chunk_memories cm join chunks c using (chunk_id) join sources s using (source_id) join seen using (memory_id)) where n = 1"))
def provenance_first_source(spark, sf_dir):
    from mnemora.operators.scope import active, scoped

    rows = active(scoped(T.memories(spark, sf_dir), T.SCOPE))
    return G.first_source(rows, T.chunk_memories(spark, sf_dir), T.chunks(spark, sf_dir), T.sources(spark, sf_dir))


@query("late_source_text", origin("select memory_id, source_id, length(content) as n from (select memory_id, memory_id // 2 as source_id from seen) join sources using (source_id)"))
def late_source_text(spark, sf_dir):
    from mnemora.operators.scope import active, scoped

    top = active(scoped(T.memories(spark, sf_dir), T.SCOPE)).select("memory_id", F.floor(F.col("memory_id") / 2).alias("source_id"))
    return G.with_source_text(top, T.sources(spark, sf_dir)).select("memory_id", "source_id", F.length("content").cast("long").alias("n"))


# --- visibility ---

CLOSURE = """reached(root, group_id) as (select distinct group_id, group_id from members union select r.root, g.subject_group from reached r join grants g on g.viewer_group = r.group_id)"""
groups = T.oracle(T.GROUPS, CLOSURE)


@query("visible_users", groups("select m.user_id from members m where m.group_id in (select group_id from reached where root in (select group_id from members where user_id = 7)) union select 7"))
def visible_users(spark, sf_dir):
    return V.visible_users(T.members(spark, sf_dir), T.grants(spark, sf_dir), 7)


@query("visible_pair_counts", groups("select v.user_id as viewer, count(distinct m.user_id) as users from members v join reached r on r.root = v.group_id join members m on m.group_id = r.group_id group by 1"))
def visible_pair_counts(spark, sf_dir):
    return V.visible_counts(T.members(spark, sf_dir), T.grants(spark, sf_dir))


@query("grant_reaches", groups("select root, group_id from reached"))
def grant_reaches(spark, sf_dir):
    start = T.members(spark, sf_dir).select(F.col("group_id").alias("root"), "group_id")
    return V.reachable(T.grants(spark, sf_dir), start)


@query("grant_impact", T.oracle(T.GROUPS, CLOSURE, CLOSURE.replace("reached", "after").replace("from after r join grants", "from after r join (select * from grants union all select 4, 5) "))("select v.user_id as viewer, m.user_id from members v join after r on r.root = v.group_id join members m on m.group_id = r.group_id except select v.user_id, m.user_id from members v join reached r on r.root = v.group_id join members m on m.group_id = r.group_id"))
def grant_impact(spark, sf_dir):
    return V.grant_impact(T.members(spark, sf_dir), T.grants(spark, sf_dir), 4, 5)


_AFTER = CLOSURE.replace("reached", "after").replace("from after r join grants", "from after r join (select * from grants union all select 4, 5) ")


@query("grant_impact_groups", T.oracle(T.GROUPS, CLOSURE, _AFTER)("select root as viewer_group, group_id as subject_group, (select count(*) from members m where m.group_id = a.root) as viewers, (select count(*) from members m where m.group_id = a.group_id) as users from after a where (root, group_id) not in (select (root, group_id) from reached)"))
def grant_impact_groups(spark, sf_dir):
    return V.grant_impact_groups(T.members(spark, sf_dir), T.grants(spark, sf_dir), 4, 5)


@query("grant_impact_counts", T.oracle(T.GROUPS, CLOSURE, _AFTER)("select viewer, count(*) as gained from (select v.user_id as viewer, m.user_id from members v join after r on r.root = v.group_id join members m on m.group_id = r.group_id except select v.user_id, m.user_id from members v join reached r on r.root = v.group_id join members m on m.group_id = r.group_id) group by 1"))
def grant_impact_counts(spark, sf_dir):
    return V.grant_impact_counts(T.members(spark, sf_dir), T.grants(spark, sf_dir), 4, 5)


@query("group_member_counts", T.oracle(T.GROUPS)("select group_id, count(*) as members from members group by 1"))
def group_member_counts(spark, sf_dir):
    return V.member_counts(T.members(spark, sf_dir))
