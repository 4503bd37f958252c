"""From raw text to facts, entities and edges: chunking, normalisation, entity resolution, edge building."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.functions.chunking import once, packed_turns, text_pieces
from mnemora.functions.fuzzy import sorted_words, token_sort_ratio_column
from mnemora.functions.text import casefold, collapse, relation_name, without_nul, word_count
from mnemora.functions.times import parse_iso
from mnemora.functions.vectors import unit_score
from mnemora.operators.lifecycle import insert_if_absent
from mnemora.operators.names import similar_names

SEGMENT, CONVERSATION_MAX = 4, 4000
TEXT_TARGET, TEXT_MAX, MOST_CHUNKS = 2000, 4000, 500
MIN_WORDS, MIN_IMPORTANCE, MIN_CONFIDENCE = 3, 0.2, 0.7
NAME_WORDS, DEFAULT_TYPE = 5, "object"
RESOLVE_SCORE, MIN_FUZZY = 90, 3

# fixed values: the ontology's relations with inverse and category, its entity types, and accepted values
RELATIONS = {
    "WORKS_FOR": ("EMPLOYS", "professional"), "EMPLOYS": ("WORKS_FOR", "professional"), "PREFERS": (None, "preference"), "LIKES": (None, "preference"),
    "DISLIKES": (None, "preference"), "USES": ("USED_BY", "usage"), "USED_BY": ("USES", "usage"), "KNOWS": (None, "social"), "FRIEND_OF": (None, "social"),
    "PARTNER_OF": (None, "social"), "MANAGES": ("MANAGED_BY", "professional"), "MANAGED_BY": ("MANAGES", "professional"), "LOCATED_IN": ("CONTAINS", "location"),
    "CONTAINS": ("LOCATED_IN", "location"), "OWNS": ("OWNED_BY", "ownership"), "OWNED_BY": ("OWNS", "ownership"), "PART_OF": ("HAS_PART", "structure"),
    "HAS_PART": ("PART_OF", "structure"), "ATTENDED": (None, "activity"), "VISITED": (None, "activity"), "PURCHASED": (None, "transaction"), "COST": (None, "transaction"),
    "PLANNED": (None, "activity"), "TRAVELED_TO": (None, "activity"), "RECOMMENDS": (None, "preference"), "EXPERIENCED": (None, "activity"), "MET": (None, "social"), "WITH": (None, "social"),
}
ENTITY_TYPES = ["person", "organization", "technology", "project", "concept", "location", "object"]
ROLES = ["user", "assistant", "system", "tool"]
GENERIC = [r"(?i)^\s*(okay|ok|thanks|thank you|sure|sounds good|got it)\s*\.?$", r"(?i)^\s*user\s+(asked|said|mentioned)\s+that\s*$"]
ROLE_LINE = r"^\s*(user|assistant|system|tool)\s*:\s*(.*)$"


def relation_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RELATIONS.items()], "relation string, inverse string, category string")


# --- chunking ----------------------------------------------------------------------------------


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def turns_of(sources: DataFrame) -> DataFrame:
    """(source_id, turn, content): a conversation's turns. Lines without a role belong to the turn before."""
    line = F.col("line")
    lines = sources.select("source_id", F.posexplode(F.split(stripped(F.col("content")), r"\r?\n")).alias("n", "line"))
    role = F.lower(F.regexp_extract(line, "(?i)" + ROLE_LINE, 1))
    starts = line.rlike("(?i)" + ROLE_LINE)
    shown = F.when(starts, F.regexp_replace(F.concat(role, F.lit(": "), F.regexp_extract(line, "(?i)" + ROLE_LINE, 2)), r"\s+$", "")).otherwise(line)
    order = W.partitionBy("source_id").orderBy("n")
    numbered = lines.select("source_id", "n", shown.alias("shown"), starts.alias("starts")).withColumn("part", F.sum(F.col("starts").cast("int")).over(order))
    grouped = numbered.groupBy("source_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "shown"))), lambda s: s["shown"]), "\n").alias("content"))
    clean = grouped.withColumn("content", stripped(F.col("content"))).where(F.length("content") > 0)
    return clean.select("source_id", (F.row_number().over(W.partitionBy("source_id").orderBy("part")) - 1).cast("long").alias("turn"), "content")


def chunk_conversation(turns: DataFrame, segment: int = SEGMENT, most: int = CONVERSATION_MAX) -> DataFrame:
    """(source_id, sequence, content, context): windows of `segment` turns; the context is the end of the window before."""
    windows = turns.groupBy("source_id", F.floor(F.col("turn") / segment).alias("segment")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "content"))), lambda t: t["content"]).alias("turns"))
    whole = F.array_join("turns", "\n")
    tail = F.when(F.length(whole) <= most, whole).otherwise(F.substring(whole, -most, most))
    by_source = W.partitionBy("source_id").orderBy("segment")
    windows = windows.withColumns({"context": F.lag(tail).over(by_source), "pieces": packed_turns(F.col("turns"), most)})
    pieces = windows.withColumn("before", F.coalesce(F.sum(F.size("pieces")).over(by_source.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = pieces.select("source_id", "before", "context", F.posexplode("pieces").alias("k", "content"))
    return cut.select("source_id", (F.col("before") + F.col("k")).cast("long").alias("sequence"), "content", "context")


def chunk_text(sources: DataFrame, target: int = TEXT_TARGET, most: int = TEXT_MAX) -> DataFrame:
    """(source_id, sequence, content) of prose."""
    texts = sources.select("source_id", stripped(F.coalesce("content", F.lit(""))).alias("content"))
    return texts.select("source_id", F.posexplode(once(F.col("content"), lambda t: text_pieces(t, target, most))).alias("sequence", "content")).withColumn("sequence", F.col("sequence").cast("long"))


def kind_of(sources: DataFrame) -> Column:
    """The content type in lower case, `text` where there is none; a session id makes text a conversation."""
    named = F.lower(F.coalesce("content_type", F.lit("text")))
    return F.when(named.isin("text", "markdown") & F.col("session_id").isNotNull(), "conversation").otherwise(named)


def chunk_sources(sources: DataFrame) -> DataFrame:
    """All chunks: conversations (by content type, or a session id that is a string) and prose, without NUL characters.
    Sources of other types have none, see unsupported()."""
    rows = sources.select("source_id", without_nul(F.col("content")).alias("content"), kind_of(sources).alias("kind"))
    a = chunk_conversation(turns_of(rows.where("kind = 'conversation'"))).withColumn("chunker", F.lit("conversation"))
    b = chunk_text(rows.where("kind in ('text', 'markdown')")).select("*", F.lit(None).cast("string").alias("context"), F.lit("recursive").alias("chunker"))
    return a.unionByName(b)


def unsupported(sources: DataFrame) -> DataFrame:
    """(source_id, reason) of sources of no known content type, for the dead-letter table."""
    rows = sources.select("source_id", "content_type", kind_of(sources).alias("kind")).where("kind not in ('text', 'markdown', 'conversation')")
    return rows.select("source_id", F.concat(F.lit("unsupported content type: "), F.col("content_type")).alias("reason"))


def oversized(chunks: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """Sources of too many chunks, for the dead-letter table."""
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunks")).where(F.col("chunks") > most).withColumn("reason", F.lit("too_many_chunks"))


def plan_batch(chunks: int, next_sequence: int, budget: int) -> tuple[int, int, int]:
    """(start, end, remaining) of the next resumable batch."""
    start = min(max(next_sequence, 0), chunks)
    end = min(start + max(budget, 0), chunks)
    return start, end, chunks - end


def planned_batches(progress: DataFrame, budget: int) -> DataFrame:
    """The same for a table of (source_id, chunks, next_sequence): start, end and remaining of each source's next batch."""
    start = F.least(F.greatest("next_sequence", F.lit(0)), F.col("chunks"))
    end = F.least(start + max(budget, 0), F.col("chunks"))
    return progress.select("source_id", start.alias("start"), end.alias("end"), (F.col("chunks") - end).alias("remaining"))


# --- normalisation of extracted facts -------------------------------------------------------------


def drop_reason(memory_types: list[str]) -> Column:
    """Why a raw fact is dropped, else null; of columns content, memory_type, speaker_role and importance_score."""
    text = collapse(F.coalesce("content", F.lit("")))
    score = unit_score(F.col("importance_score"))
    return (
        F.when((word_count(text) < MIN_WORDS) | text.rlike(GENERIC[0]) | text.rlike(GENERIC[1]), "low_signal_content")
        .when(~F.coalesce(F.col("memory_type").isin(memory_types), F.lit(False)), "invalid_memory_type")
        .when(~F.col("speaker_role").isin(ROLES[:2]), "invalid_speaker_role")
        .when(score.isNull() | (score < MIN_IMPORTANCE), "low_importance_score")
    )


def normalize_facts(raw: DataFrame, memory_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, drops) of raw memories (source_id, chunk, idx, content, memory_type, speaker_role, importance_score, event_time).

    Facts of one source that agree in text, type, role and event time are one: the first stays.
    """
    rows = raw.withColumns({"reason": drop_reason(memory_types), "fact": collapse(F.col("content")), "event_at": parse_iso(F.col("event_time"))})
    key = ["source_id", F.lower("fact"), "memory_type", F.coalesce("speaker_role", F.lit("")), F.coalesce(F.unix_micros("event_at"), F.lit(-1))]
    good = rows.where("reason is null").withColumn("n_", F.row_number().over(W.partitionBy(*key).orderBy("chunk", "idx")))
    facts = good.where("n_ = 1").select("source_id", "chunk", "idx", F.col("fact").alias("content"), "memory_type", "speaker_role", "importance_score", F.col("event_at").alias("event_time"))
    drops = rows.where("reason is not null").select("reason").unionByName(good.where("n_ > 1").select(F.lit("duplicate_fact").alias("reason")))
    return facts, drops.groupBy("reason").agg(F.count("*").alias("n"))


def graph_of_facts(facts: DataFrame, graphs: DataFrame) -> DataFrame:
    """Joins graph results (source_id, chunk, pos, index, entities, relations) by index; the first of an index wins."""
    g = graphs.withColumn("n_", F.row_number().over(W.partitionBy("source_id", "chunk", "index").orderBy("pos"))).where("n_ = 1")
    return facts.join(g.select("source_id", "chunk", F.col("index").alias("idx"), "entities", "relations"), ["source_id", "chunk", "idx"], "left")


FACT = ["source_id", "chunk", "idx"]


def relations_of(graph: DataFrame) -> DataFrame:
    """Usable relations of facts: named, between two different names, confident enough."""
    rel = graph.select(*FACT, "event_time", F.posexplode("relations").alias("pos", "r"))
    rel = rel.select(*FACT, "pos", collapse(F.col("r.subject")).alias("subject"), relation_name(F.col("r.relation")).alias("relation"), collapse(F.col("r.object")).alias("object"), unit_score(F.col("r.confidence")).alias("confidence"), F.coalesce(parse_iso(F.col("r.valid_from")), "event_time").alias("valid_from"))
    return rel.where((F.col("relation") != "") & (F.col("subject") != "") & (F.col("object") != "") & (F.lower("subject") != F.lower("object")) & (F.col("confidence") >= MIN_CONFIDENCE))


def entities_of(graph: DataFrame) -> DataFrame:
    """(fact, name, entity_type): named entities, each name once a fact, and names of up to five words that only relations have."""
    ent = graph.select(*FACT, F.posexplode("entities").alias("pos", "e"))
    kind = F.when(F.trim("e.entity_type") != "", F.trim("e.entity_type")).otherwise(DEFAULT_TYPE)
    named = ent.select(*FACT, F.lit(0).alias("tier"), "pos", collapse(F.col("e.name")).alias("name"), kind.alias("entity_type")).where("name <> ''")
    rel = relations_of(graph).select(*FACT, F.lit(1).alias("tier"), F.col("pos"), F.explode(F.array("subject", "object")).alias("name"), F.lit(DEFAULT_TYPE).alias("entity_type")).where(word_count(F.col("name")) <= NAME_WORDS)
    order = W.partitionBy(*FACT, F.lower("name")).orderBy("tier", "pos", "name")
    return named.unionByName(rel).withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_", "tier")


def unique_entities(entities: DataFrame) -> DataFrame:
    """(key, name, entity_type) over all facts: the first spelling and type of a name."""
    first = entities.groupBy(casefold(F.col("name")).alias("key")).agg(F.min_by(F.struct("name", "entity_type"), F.struct(*FACT, "pos")).alias("e"))
    return first.select("key", "e.name", "e.entity_type")


def entity_id_of(space: Column, key: Column) -> Column:
    """An id that depends on space and name alone, so tasks and reruns agree on it."""
    return F.xxhash64(space, key)


def resolve_entities(names: DataFrame, entities: DataFrame, pool: DataFrame | None = None, space: int = 0, score: int = RESOLVE_SCORE) -> DataFrame:
    """(key, name, entity_id, how): exactly one entity of the name; else the best of the candidate pool (key, entity_id)
    by token-sort ratio; else a new entity. Ties go to the smaller id."""
    exact = entities.groupBy(casefold(F.col("name")).alias("key")).agg(F.count("*").alias("same"), F.min("entity_id").alias("exact_id"))
    out = names.join(exact.where("same = 1").select("key", "exact_id"), "key", "left")
    best = F.lit(None).cast("long")
    if pool is not None:
        open_names = out.where(F.col("exact_id").isNull() & (F.length("key") >= MIN_FUZZY)).select("key")
        pairs = pool.join(open_names, "key", "left_semi").join(entities.select("entity_id", F.col("name").alias("candidate")), "entity_id")
        rated = pairs.withColumn("ratio", token_sort_ratio_column(F.col("key"), F.col("candidate"))).where(F.col("ratio") >= score)
        chosen = rated.groupBy("key").agg(F.min_by("entity_id", F.struct(-F.col("ratio"), F.col("entity_id"))).alias("fuzzy_id"))
        out, best = out.join(chosen, "key", "left"), F.col("fuzzy_id")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(best.isNotNull(), "fuzzy").otherwise("new")
    return out.select("key", "name", F.coalesce("exact_id", best, entity_id_of(F.lit(space), F.col("key"))).alias("entity_id"), how.alias("how"))


def _least_common(total: int) -> int:
    """The least common length that gives two names of `total` characters the ratio RESOLVE_SCORE."""
    least = max(0, int((RESOLVE_SCORE - 0.5) * total / 200) - 1)
    while int(200 * least / total + 0.5) < RESOLVE_SCORE:
        least += 1
    return least


@cache
def _shared_grams(n: int) -> int:
    """How many character trigrams a name of n characters shares at least with any that it resolves to.

    A common subsequence of L of a + b characters has L trigrams, the name's ends included, and each of
    the a + b - 2L other characters parts two of them at most.
    """
    return min(5 * least - 2 * (n + m) for m in range(1, 2 * n + 1) if (least := _least_common(n + m)) <= min(n, m))


def _name_grams(name: Column) -> Column:
    """(n, front, grams): length of the sorted words, how many of the rarest grams must hold a shared one, and the
    trigrams, equal ones numbered."""

    @F.pandas_udf("n int, front int, grams array<string>")
    def grams(names: pd.Series) -> pd.DataFrame:
        out = []
        for text in map(sorted_words, names.fillna("")):
            n, seen, got = len(text), {}, []
            framed = f"\x01{text}\x02"
            for k in range(n):
                g = framed[k : k + 3]
                seen[g] = seen.get(g, 0) + 1
                got.append(f"{g}{seen[g]}")
            out.append((n, n - _shared_grams(n) + 1 if n else 0, got))
        return pd.DataFrame(out, columns=["n", "front", "grams"])

    return grams(name)


def similar_name_pool(names: DataFrame, entities: DataFrame) -> DataFrame:
    """A candidate pool (key, entity_id) for names without vectors: it has every pair whose ratio reaches RESOLVE_SCORE.

    Such names share one of their rarest trigrams (a prefix filter), and their lengths allow the ratio.
    """
    cut = lambda df, key, name: df.select(F.col(key).alias("id"), _name_grams(F.col(name)).alias("x")).select("id", "x.n", "x.front", F.explode("x.grams").alias("g"))
    left, right = cut(names.select("key").distinct(), "key", "key"), cut(entities.select("entity_id", "name").distinct().withColumn("own", F.struct("entity_id", "name")), "own", "name")
    weight = right.groupBy("g").agg(F.count("*").alias("c"))

    def front(rows: DataFrame) -> DataFrame:
        ranked = rows.join(weight, "g", "left").groupBy("id", "n", "front").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g"))).alias("all"))
        return ranked.select("id", "n", F.explode(F.slice("all", F.lit(1), F.col("front"))).alias("e")).select("id", "n", "e.g")

    met = front(left).select(F.col("id").alias("key"), "n", "g").join(front(right).select("id", F.col("n").alias("m"), "g"), "g")
    fits = F.floor(200 * F.least("n", "m") / (F.col("n") + F.col("m")) + 0.5) >= RESOLVE_SCORE
    return met.where(fits).select("key", F.col("id.entity_id").alias("entity_id")).distinct()


def entity_pool(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, entity_id): every pair that can resolve, and each name's nearest entities by cosine of their trigrams."""
    near = similar_names(names.select("key", F.col("key").alias("name")), entities).select("key", "entity_id")
    return similar_name_pool(names, entities).unionByName(near).distinct()


def memory_entity_links(entities: DataFrame, resolved: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New distinct (source_id, chunk, idx, entity_id) links."""
    links = entities.withColumn("key", casefold(F.col("name"))).join(resolved.select("key", "entity_id"), "key").select(*FACT, "entity_id").distinct()
    return links if existing is None else links.join(existing, [*FACT, "entity_id"], "left_anti")


def build_edges(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges between resolved names; of equal triples of a source the first stays, loops go."""
    ids = resolved.select("key", "entity_id")
    a = ids.select(F.col("key").alias("skey"), F.col("entity_id").alias("source_entity"))
    b = ids.select(F.col("key").alias("okey"), F.col("entity_id").alias("target_entity"))
    rows = relations.withColumns({"skey": casefold(F.col("subject")), "okey": casefold(F.col("object"))}).join(a, "skey").join(b, "okey").where("source_entity <> target_entity")
    order = W.partitionBy("source_id", "source_entity", "relation", "target_entity").orderBy("chunk", "idx", "pos")
    return rows.withColumn("n_", F.row_number().over(order)).where("n_ = 1").select(*FACT, "source_entity", "relation", "target_entity", "confidence", "valid_from")


def row_id(*key: Column) -> Column:
    """60 bits of an MD5 of a key: the same row has the same id however often it is written."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *key)), 1, 15), 16, 10).cast("long")


def persist_window(tables: dict[str, DataFrame], window: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """The tables after a window of chunks (source_id, sequence, content) came in with its facts (source_id, sequence, idx,
    content, memory_type), and under `rows` the memory of each fact.

    Ids are made of the keys: a window that is put in again after a failure changes nothing. Facts of no chunk stay out.
    """
    chunks = window.withColumn("chunk_id", row_id(F.lit("chunk"), F.col("source_id"), F.col("sequence")))
    memory = row_id(F.lit("memory"), F.col("source_id"), F.col("sequence"), F.col("idx"))
    rows = facts.withColumn("memory_id", memory).join(chunks.select("source_id", "sequence", "chunk_id"), ["source_id", "sequence"])
    return tables | {
        "chunks": insert_if_absent(tables["chunks"], chunks.select(*tables["chunks"].columns), ["chunk_id"]),
        "memories": insert_if_absent(tables["memories"], rows.select(*tables["memories"].columns), ["memory_id"]),
        "chunk_memories": insert_if_absent(tables["chunk_memories"], rows.select(*tables["chunk_memories"].columns), ["chunk_id", "memory_id"]),
        "rows": rows.select("source_id", "sequence", "idx", "chunk_id", "memory_id"),
    }


def purge(tables: dict[str, DataFrame], source_ids: DataFrame, least: int = 0) -> dict[str, DataFrame]:
    """The tables after a partial batch (chunks of `least` and later) of some sources is taken back."""
    chunks = tables["chunks"]
    doomed = chunks.join(source_ids, "source_id", "left_semi").where(F.col("sequence") >= least).select("chunk_id")
    links = tables["chunk_memories"]
    memories = links.join(doomed, "chunk_id", "left_semi").select("memory_id").distinct()
    return tables | {
        "edges": tables["edges"].join(memories, "memory_id", "left_anti"),
        "memory_entities": tables["memory_entities"].join(memories, "memory_id", "left_anti"),
        "memories": tables["memories"].join(memories, "memory_id", "left_anti"),
        "chunk_memories": links.join(doomed, "chunk_id", "left_anti"),
        "chunks": chunks.join(doomed, "chunk_id", "left_anti"),
    }


def memory_hints(chunk_vectors: DataFrame, vectors: DataFrame, memories: DataFrame, k: int = 10) -> DataFrame:
    """(chunk, hints): per chunk the texts of its nearest active memories, nearest first."""
    from mnemora.operators.knn import nearest_batch

    near = nearest_batch(vectors, chunk_vectors, k, 0.0).withColumnRenamed("vec_id", "memory_id")
    text = near.join(memories.where("forgotten_at is null").select("memory_id", "content"), "memory_id")
    return text.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda s: s["content"]).alias("hints"))

