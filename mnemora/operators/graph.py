"""The knowledge graph: edges of a frontier, bounded walks, the graph signal, viewport and statistics.

A condition "source or target is in the frontier" is two equi-joins and a union, never an OR join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.functions.text import tokenize
from mnemora.functions.times import edge_recency
from mnemora.operators.names import similar_names
from mnemora.operators.scope import TenantScope, active, scoped
from mnemora.sources.scratch import written

MAX_DEPTH, DECAY = 2, 0.5
SEEDS, SEEDS_EACH, SEED_COSINE = 10, 5, 0.2
MIN_CONFIDENCE, EDGES_PER_HOP, MEMORY_BUDGET = 0.3, 200, 100
HISTOGRAM = 20


@dataclass
class GraphTables:
    memories: DataFrame
    entities: DataFrame
    edges: DataFrame
    memory_entities: DataFrame


def memories_of_entities(g: GraphTables, entities: DataFrame, scope: TenantScope) -> DataFrame:
    """(entity_id, memory_id) links to memories that the scope sees."""
    links = g.memory_entities.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return links.join(active(scoped(g.memories, scope)).select("memory_id"), "memory_id", "left_semi").select("entity_id", "memory_id")


def entities_of_memories(g: GraphTables, memories: DataFrame, scope: TenantScope) -> DataFrame:
    """(memory_id, entity_id) links of memories that the scope sees."""
    seen = active(scoped(g.memories, scope)).select("memory_id").join(memories.select("memory_id").distinct(), "memory_id", "left_semi")
    return g.memory_entities.join(seen, "memory_id", "left_semi").select("memory_id", "entity_id")


def linked_to_visible(g: GraphTables, entities: DataFrame, scope: TenantScope) -> DataFrame:
    """Entities that some visible memory names."""
    seen = g.memory_entities.join(active(scoped(g.memories, scope)).select("memory_id"), "memory_id", "left_semi")
    return entities.join(seen.select("entity_id"), "entity_id", "left_semi")


def usable_edges(edges: DataFrame, scope: TenantScope, as_of: Column | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Edges of the scope that are confident enough and hold at a time; `at` is when they began to hold."""
    out = active(scoped(edges, scope, "graph_edge")).withColumn("at", F.coalesce("valid_from", "recorded_at"))
    out = out.where(F.coalesce("confidence", F.lit(1.0)) >= least)
    return out if as_of is None else out.where(F.col("at") <= as_of)


def edges_for(edges: DataFrame, frontier: DataFrame, cap: int = EDGES_PER_HOP) -> DataFrame:
    """The newest `cap` edges that touch the frontier (entity_id, relevance), anchored at their source if it is in it."""
    near = frontier.select(F.col("entity_id").alias("anchor"), "relevance")
    by_source = edges.join(near, F.col("source_id") == F.col("anchor")).withColumn("other", F.col("target_id")).withColumn("side", F.lit(0))
    by_target = edges.join(near, F.col("target_id") == F.col("anchor")).withColumn("other", F.col("source_id")).withColumn("side", F.lit(1))
    both = by_source.unionByName(by_target)
    one = both.groupBy("edge_id").agg(F.min_by(F.struct(*[c for c in both.columns if c != "edge_id"]), "side").alias("e")).select("edge_id", "e.*")
    top = one.orderBy(F.desc("at"), F.desc("edge_id")).limit(cap)
    return top.withColumn("ordinal", F.row_number().over(W.orderBy(F.desc("at"), F.desc("edge_id"))).cast("long"))


def walk(g: GraphTables, seeds: DataFrame, scope: TenantScope, now: Column, as_of: Column | None = None, depth: int = MAX_DEPTH, budget: int = MEMORY_BUDGET) -> DataFrame:
    """(memory_id, score) reached from the seeds (entity_id, relevance) over at most `depth` hops.

    Every table in the loop is bounded by the seeds and the cap per hop; the loop runs at most `depth` times.
    """
    edges = usable_edges(g.edges, scope, as_of)
    links = memories_of_entities(g, seeds, scope)
    scores = links.join(seeds, "entity_id").groupBy("memory_id").agg(F.max("relevance").alias("score"))
    frontier, visited = seeds, seeds.select("entity_id")
    for d in range(1, depth + 1):
        if scores.limit(budget).count() >= budget:
            break
        hop = edges_for(edges, frontier)
        gain = F.coalesce("confidence", F.lit(1.0)) * F.exp(F.lit(-DECAY * d)) * F.col("relevance") * edge_recency(F.col("valid_from"), F.col("recorded_at"), now)
        hop = written(hop.withColumn("score", gain), "hop")  # at most `cap` rows
        reached = hop.where(F.col("memory_id").isNotNull() & (F.col("score") > 0)).select("memory_id", "score")
        scores = scores.unionByName(reached).groupBy("memory_id").agg(F.max("score").alias("score"))
        frontier = hop.groupBy(F.col("other").alias("entity_id")).agg(F.max("score").alias("relevance")).join(visited, "entity_id", "left_anti")
        visited = visited.unionByName(frontier.select("entity_id"))
    return scores


def seeds_by_memory(g: GraphTables, matches: DataFrame, scope: TenantScope) -> DataFrame:
    """(entity_id, relevance) of the entities that the nearest memories (memory_id, score) name."""
    return entities_of_memories(g, matches, scope).join(matches.select("memory_id", "score"), "memory_id").groupBy("entity_id").agg(F.max("score").alias("relevance"))


def seeds_by_name(entities: DataFrame, query: Column, limit: int = SEEDS_EACH) -> DataFrame:
    """(entity_id, relevance) by the share of the query's words in a name, as a share of the best."""
    asked = tokenize(query)
    share = F.size(F.array_intersect(tokenize(F.col("name")), asked)) / F.greatest(F.size(asked), F.lit(1))
    top = entities.select("entity_id", share.alias("share")).where("share > 0").orderBy(F.desc("share"), "entity_id").limit(limit)
    return top.withColumn("relevance", F.col("share") / F.max("share").over(W.partitionBy())).drop("share")


def seeds_by_likeness(entities: DataFrame, query: str, limit: int = SEEDS_EACH, least: float = SEED_COSINE) -> DataFrame:
    """(entity_id, relevance) of the entities whose names are nearest to the query, by cosine of their trigrams."""
    asked = entities.sparkSession.range(1).select(F.col("id").alias("key"), F.lit(query).alias("name"))
    return similar_names(asked, entities, least, limit).select("entity_id", F.col("cosine").alias("relevance"))


def top_seeds(*parts: DataFrame, most: int = SEEDS) -> DataFrame:
    """The best seeds over all strategies, each entity by its best relevance."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity_id").agg(F.max("relevance").alias("relevance")).orderBy(F.desc("relevance"), "entity_id").limit(most)


def graph_signal(g: GraphTables, seeds: DataFrame, scope: TenantScope, now: Column, as_of: Column | None = None, depth: int = MAX_DEPTH, limit: int = 50) -> DataFrame:
    """(memory_id, rank, score): what the walk reached and the scope sees, as a share of the best."""
    seen = walk(g, seeds, scope, now, as_of, depth).join(active(scoped(g.memories, scope)).select("memory_id"), "memory_id", "left_semi")
    best = seen.orderBy(F.desc("score"), "memory_id").limit(limit)
    top = F.max("score").over(W.partitionBy())
    scored = best.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "memory_id")).cast("long")).select("memory_id", "rank", "score")


# --- many requests at once ----------------------------------------------------------------------


def seeds_by_names(entities: DataFrame, texts: DataFrame, limit: int = SEEDS_EACH) -> DataFrame:
    """(query, entity_id, relevance): seeds_by_name() for each text of a table (query).

    A share depends only on which of the asked words a name has. Entities that have the same ones count as one set,
    of which the `limit` smallest ids stand for all, so a word that very many names have is met once a text.
    """
    asked = texts.select("query", tokenize(F.col("query")).alias("words"))
    words = asked.select("query", F.size("words").alias("size"), F.explode("words").alias("word"))
    own = entities.select("entity_id", F.explode(tokenize(F.col("name"))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    sets = own.groupBy("entity_id").agg(F.sort_array(F.collect_set("word")).alias("have"))
    sets = sets.withColumn("n_", F.row_number().over(W.partitionBy("have").orderBy("entity_id"))).where(F.col("n_") <= limit)
    sets = sets.groupBy("have").agg(F.collect_list("entity_id").alias("ids"))
    met = sets.select("have", "ids", F.explode("have").alias("word")).join(words, "word").groupBy("query", "have").agg((F.count("*") / F.first("size")).alias("share"), F.first("ids").alias("ids"))
    rows = met.select("query", F.explode("ids").alias("entity_id"), "share")
    top = rows.withColumn("n_", F.row_number().over(W.partitionBy("query").orderBy(F.desc("share"), "entity_id"))).where(F.col("n_") <= limit)
    return top.select("query", "entity_id", (F.col("share") / F.max("share").over(W.partitionBy("query"))).alias("relevance"))


def top_seeds_each(seeds: DataFrame, most: int = SEEDS) -> DataFrame:
    """top_seeds() of each query_id. Relevance has nine digits, so what is equal but for the order of sums ties."""
    best = seeds.groupBy("query_id", "entity_id").agg(F.round(F.max("relevance"), 9).alias("relevance"))
    ranked = best.withColumn("n_", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "entity_id")))
    return ranked.where(F.col("n_") <= most).drop("n_")


def edge_ends(edges: DataFrame) -> DataFrame:
    """A row for each end of an edge: anchor, the other end, and its side (0: the anchor is the source). A loop has one."""
    end = lambda a, b, side: F.struct(F.col(a).alias("anchor"), F.col(b).alias("other"), F.lit(side).alias("side"))
    ends = F.explode(F.array(end("source_id", "target_id", 0), end("target_id", "source_id", 1))).alias("e")
    rows = edges.select("edge_id", "memory_id", "confidence", "valid_from", "recorded_at", "at", ends)
    return rows.select("*", "e.*").drop("e").where("side = 0 or anchor <> other")


def edges_for_each(ends: DataFrame, frontier: DataFrame, cap: int = EDGES_PER_HOP) -> DataFrame:
    """edges_for() of each query of a frontier (query_id, as_of, entity_id, relevance).

    What a query keeps are among the newest `cap` edges of each of its entities as of its time, so these are cut for
    each entity and time before they meet the queries.
    """
    newest = F.desc("at"), F.desc("edge_id")
    asked = frontier.select(F.col("entity_id").alias("anchor"), "as_of").distinct()
    near = ends.join(asked, "anchor").where("as_of is null or at <= as_of")
    near = near.withColumn("n_", F.row_number().over(W.partitionBy("anchor", "as_of").orderBy(*newest))).where(F.col("n_") <= cap).drop("n_")
    wanted = frontier.select("query_id", F.col("entity_id").alias("anchor_"), F.col("as_of").alias("as_of_"), "relevance")
    met = near.join(wanted, (F.col("anchor") == F.col("anchor_")) & F.col("as_of").eqNullSafe(F.col("as_of_")))
    kept = ["memory_id", "confidence", "valid_from", "recorded_at", "at", "other", "relevance"]
    one = met.groupBy("query_id", "edge_id").agg(F.min_by(F.struct(*kept), "side").alias("e")).select("query_id", "edge_id", "e.*")
    return one.withColumn("ordinal", F.row_number().over(W.partitionBy("query_id").orderBy(*newest)).cast("long")).where(F.col("ordinal") <= cap)


def walk_each(g: GraphTables, seeds: DataFrame, requests: DataFrame, scope: TenantScope, now: Column, budget: int = MEMORY_BUDGET) -> DataFrame:
    """(query_id, memory_id, score): walk() of each query, with its own frontier, cap and visited entities.

    seeds: (query_id, entity_id, relevance); requests: (query_id, as_of, depth). Of what a seed links directly only its
    `budget` smallest memories are kept: all of an entity's have the same score and ties go to the smaller id, so the
    best `budget` of a query, and whether it has as many, stay the same.
    """
    ends = edge_ends(usable_edges(g.edges, scope))
    asked = requests.where("depth > 0").select("query_id", "as_of", "depth")
    seeds = seeds.join(asked, "query_id")
    links = memories_of_entities(g, seeds, scope).withColumn("n_", F.row_number().over(W.partitionBy("entity_id").orderBy("memory_id"))).where(F.col("n_") <= budget).drop("n_")
    scores = written(links.join(seeds, "entity_id").groupBy("query_id", "memory_id").agg(F.max("relevance").alias("score")), "scores")
    frontier, visited = seeds, seeds.select("query_id", "entity_id")
    for d in range(1, MAX_DEPTH + 1):
        full = scores.groupBy("query_id").agg(F.count("*").alias("n_")).where(F.col("n_") >= budget)
        frontier = frontier.where(F.col("depth") >= d).join(full, "query_id", "left_anti")
        gain = F.coalesce("confidence", F.lit(1.0)) * F.exp(F.lit(-DECAY * d)) * F.col("relevance") * edge_recency(F.col("valid_from"), F.col("recorded_at"), now)
        hop = written(edges_for_each(ends, frontier).select("query_id", "memory_id", "other", gain.alias("score")), "hop")
        reached = hop.where(F.col("memory_id").isNotNull() & (F.col("score") > 0)).select("query_id", "memory_id", "score")
        scores = scores.unionByName(reached).groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))
        frontier = hop.groupBy("query_id", F.col("other").alias("entity_id")).agg(F.max("score").alias("relevance")).join(visited, ["query_id", "entity_id"], "left_anti").join(asked, "query_id")
        visited = visited.unionByName(frontier.select("query_id", "entity_id"))
    return scores


def graph_signal_each(g: GraphTables, seeds: DataFrame, requests: DataFrame, scope: TenantScope, now: Column, limit: int = 50) -> DataFrame:
    """(query_id, memory_id, rank, score): graph_signal() of each query."""
    seen = walk_each(g, seeds, requests, scope, now).join(active(scoped(g.memories, scope)).select("memory_id"), "memory_id", "left_semi")
    own = W.partitionBy("query_id")
    best = seen.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "memory_id")).cast("long")).where(F.col("rank") <= limit)
    top = F.max("score").over(own)
    return best.select("query_id", "memory_id", "rank", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")).alias("score"))


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, degree): edges at either end; a loop counts at both."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count("*").alias("degree"))


def with_visible_edge(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.join(degrees(edges).select("entity_id"), "entity_id", "left_semi")


def viewport(entities: DataFrame, edges: DataFrame, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of nodes by degree, and the most confident edges that touch it (three per node at most)."""
    ranked = entities.join(degrees(edges), "entity_id").orderBy(F.desc("degree"), "entity_id").offset(offset).limit(limit)
    page = ranked.select("entity_id")
    ends = edges.join(page.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").unionByName(edges.join(page.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")).dropDuplicates(["edge_id"])
    return ranked, ends.orderBy(F.coalesce("confidence", F.lit(1.0)).desc(), "edge_id").limit(3 * limit)


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.count("*").alias("n"))


def relation_histogram(edges: DataFrame, most: int = HISTOGRAM) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation_type").limit(most)


def entity_detail(g: GraphTables, entity_id: int, scope: TenantScope, newest: int = 10) -> DataFrame:
    """The newest memories that name an entity."""
    links = g.memory_entities.where(F.col("entity_id") == entity_id).select("memory_id")
    rows = active(scoped(g.memories, scope)).join(links, "memory_id", "left_semi")
    return rows.orderBy(F.desc("created_at"), F.desc("memory_id")).limit(newest)


def latest_version(edges: DataFrame) -> DataFrame:
    """Of each triple the edge that holds last."""
    order = W.partitionBy("source_id", "relation_type", "target_id").orderBy(F.desc(F.coalesce("valid_from", "recorded_at")), F.desc("edge_id"))
    return edges.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def first_source(candidates: DataFrame, chunk_memories: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(memory_id, source_id, sequence, session_id): where a memory comes from first, by source and then sequence."""
    links = chunk_memories.join(candidates.select("memory_id").distinct(), "memory_id", "left_semi")
    found = links.join(chunks.select("chunk_id", "source_id", "sequence"), "chunk_id").join(sources.select("source_id", "session_id"), "source_id")
    first = found.groupBy("memory_id").agg(F.min(F.struct("source_id", "sequence", "session_id")).alias("s"))
    return first.select("memory_id", "s.source_id", "s.sequence", "s.session_id")


def with_source_text(selected: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins the wide text late: to the selected rows only."""
    return selected.join(sources.select("source_id", "content"), "source_id", "left")
