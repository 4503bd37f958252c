"""Registered queries: chunking, fact normalisation, entity resolution and edge building."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions.fuzzy import token_sort_ratio_column
from mnemora.functions.text import casefold, format_messages
from mnemora.functions.times import WEEKDAYS, infer_event_date, parse_iso
from mnemora.operators import ingestion as I
from mnemora.operators.names import similar_names
from mnemora.plans import tables as T
from mnemora.sources.scratch import written

QUERIES, ORACLE_SQL = {}, {}
TYPES = ["fact", "preference", "event"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _talks(spark, sf_dir):
    """Conversations as sources, with line breaks inside a turn made blanks: each line is a turn."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    g = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", flat.alias("text")).groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("t"))
    return g.select(F.col("conv_id").alias("source_id"), format_messages(F.col("t")).alias("content"), F.lit("conversation").alias("content_type"), F.lit(None).cast("string").alias("session_id"))


_LINES = r"select conv_id, turn, rtrim(role || ': ' || rtrim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as line from conversations"


@query("parse_turns", f"select conv_id as source_id, row_number() over (partition by conv_id order by turn) - 1 as turn, sha256(line) as digest from ({_LINES})")
def parse_turns(spark, sf_dir):
    return I.turns_of(_talks(spark, sf_dir)).select("source_id", "turn", F.sha2("content", 256).alias("digest"))


@query("conversation_windows", f"select conv_id as source_id, turn // 4 as segment, length(string_agg(line, chr(10) order by turn)) as n from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, line from ({_LINES})) group by 1, 2")
def conversation_windows(spark, sf_dir):
    out = I.chunk_conversation(I.turns_of(_talks(spark, sf_dir)), most=10_000_000)
    return out.select("source_id", F.col("sequence").alias("segment"), F.length("content").cast("long").alias("n"))


# pieces that are too long are parted at one separator after the other; then they are packed one by one
_BLANK = r"[\x09-\x0D\x20]+"


def _parted(pieces: str) -> str:
    for mark in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"):
        parts = f"list_filter(string_split(a, {mark}), lambda p: p <> '')"
        pieces = f"flatten(list_transform({pieces}, lambda a: case when length(a) <= 4000 or len({parts}) <= 1 then [a] else {parts} end))"
    return f"flatten(list_transform({pieces}, lambda a: case when length(a) <= 4000 then [a] else list_transform(range(0, (length(a) + 3999) // 4000), lambda i: substr(a, i * 4000 + 1, 4000)) end))"


PROSE = rf"""stripped as (select doc_id as source_id, regexp_replace(coalesce(text, ''), '^{_BLANK}|{_BLANK}$', '', 'g') as t from documents),
prose as (select source_id, case when length(t) <= 2000 then [t] else {_parted("[t]")} end as p from stripped where t <> ''),
packed(source_id, p, i, seq, cur) as (select source_id, p, 1, 0, p[1] from prose
  union all select source_id, p, i + 1, case when length(cur) + 1 + length(p[i + 1]) <= 2000 then seq else seq + 1 end, case when length(cur) + 1 + length(p[i + 1]) <= 2000 then cur || chr(10) || p[i + 1] else p[i + 1] end from packed where i < len(p)),
texts as (select source_id, seq::bigint as sequence, arg_max(cur, i) as content from packed group by 1, 2)"""
TALKS = rf"""spoken as (select conv_id, line, row_number() over (partition by conv_id order by turn) - 1 as n from ({_LINES})),
segments as (select conv_id, n // 4 as segment, string_agg(line, chr(10) order by n) as whole, list(line order by n) as lines from spoken group by 1, 2),
cut as (select *, flatten(list_transform(lines, lambda x: case when length(x) <= 4000 then [struct_pack(t := x, alone := false)] else list_transform({_parted("[x]")}, lambda y: struct_pack(t := y, alone := true)) end)) as p,
  right(lag(whole) over (partition by conv_id order by segment), 4000) as context from segments),
joined(conv_id, segment, context, p, i, seq, cur) as (select conv_id, segment, context, p, 1, 0, p[1].t from cut
  union all select conv_id, segment, context, p, i + 1, case when not p[i].alone and not p[i + 1].alone and length(cur) + 1 + length(p[i + 1].t) <= 4000 then seq else seq + 1 end,
    case when not p[i].alone and not p[i + 1].alone and length(cur) + 1 + length(p[i + 1].t) <= 4000 then cur || chr(10) || p[i + 1].t else p[i + 1].t end from joined where i < len(p)),
talks as (select conv_id as source_id, row_number() over (partition by conv_id order by segment, seq) - 1 as sequence, content, context from (select conv_id, segment, seq, any_value(context) as context, arg_max(cur, i) as content from joined group by 1, 2, 3))"""


@query("chunk_conversation", T.oracle(TALKS)("select source_id, sequence, content, context from talks"))
def chunk_conversation(spark, sf_dir):
    return I.chunk_conversation(I.turns_of(_talks(spark, sf_dir)))


@query("chunk_text", T.oracle(PROSE)("select source_id, sequence, content from texts"))
def chunk_text(spark, sf_dir):
    return I.chunk_text(T.sources(spark, sf_dir))


def _mixed(spark, sf_dir):
    """Documents as prose, every 29th of a type that isn't known, and the conversations with ids below 0."""
    kind = F.when(F.col("source_id") % 29 == 0, "pdf").otherwise(F.upper("content_type"))
    d = T.sources(spark, sf_dir).select("source_id", "content", kind.alias("content_type"), F.lit(None).cast("string").alias("session_id"))
    return d.unionByName(_talks(spark, sf_dir).withColumn("source_id", -1 - F.col("source_id")))


@query("chunk_sources", T.oracle(PROSE, TALKS)("select source_id, sequence, content, null::varchar as context, 'recursive' as chunker from texts where source_id % 29 <> 0 union all select -1 - source_id, sequence, content, context, 'conversation' from talks"))
def chunk_sources(spark, sf_dir):
    return I.chunk_sources(_mixed(spark, sf_dir))


@query("unsupported_sources", "select doc_id as source_id, 'unsupported content type: pdf' as reason from documents where doc_id % 29 = 0")
def unsupported_sources(spark, sf_dir):
    return I.unsupported(_mixed(spark, sf_dir))


@query("oversized_sources", T.oracle(T.CHUNKS)("select source_id, count(*) as chunks, 'too_many_chunks' as reason from chunks group by 1 having count(*) > 3"))
def oversized_sources(spark, sf_dir):
    return I.oversized(T.chunks(spark, sf_dir), 3)


# raw extractions: conversation turns stand for what a model extracted from a chunk


def _raw(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    return c.select(
        (F.col("conv_id") % 20).alias("source_id"), F.col("conv_id").alias("chunk"), F.col("turn").alias("idx"), text.alias("content"),
        F.when(n % 11 == 0, "opinion").when(n % 3 == 0, "event").otherwise("fact").alias("memory_type"),
        F.when(n % 13 == 0, "narrator").when(n % 2 == 0, F.col("role")).alias("speaker_role"), ((n % 12) / 10).alias("importance_score"),
        F.when(n % 4 == 0, F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00"))).alias("event_time"),
    )


RAW = r"""raw as (select conv_id % 20 as source_id, conv_id as chunk, turn as idx, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') as content,
  case when (conv_id + turn) % 11 = 0 then 'opinion' when (conv_id + turn) % 3 = 0 then 'event' else 'fact' end as memory_type, case when (conv_id + turn) % 13 = 0 then 'narrator' when (conv_id + turn) % 2 = 0 then role end as speaker_role,
  ((conv_id + turn) % 12) / 10.0 as importance_score, case when (conv_id + turn) % 4 = 0 then make_timestamp(2024, 1, (conv_id + turn) % 28 + 1, 10, 0, 0) end as event_time from conversations),
judged as (select *, trim(content) as text, case when trim(content) = '' or len(string_split(trim(content), ' ')) < 3 then 'low_signal_content' when memory_type not in ('fact', 'preference', 'event') then 'invalid_memory_type'
  when speaker_role not in ('user', 'assistant') then 'invalid_speaker_role' when importance_score > 1 or importance_score < 0.2 then 'low_importance_score' end as reason from raw),
ranked as (select *, row_number() over (partition by source_id, lower(text), memory_type, coalesce(speaker_role, ''), event_time order by chunk, idx) as n from judged where reason is null)"""


@query("normalize_facts", T.oracle(RAW)("select source_id, chunk, idx, sha256(text) as digest, memory_type, epoch(event_time)::bigint as event from ranked where n = 1"))
def normalize_facts(spark, sf_dir):
    facts = I.normalize_facts(_raw(spark, sf_dir), TYPES)[0]
    return facts.select("source_id", "chunk", "idx", F.sha2("content", 256).alias("digest"), "memory_type", F.unix_timestamp("event_time").alias("event"))


@query("drop_reasons", T.oracle(RAW)("select reason, count(*) as n from judged where reason is not null group by 1 union all select 'duplicate_fact', count(*) from ranked where n > 1 having count(*) > 0"))
def drop_reasons(spark, sf_dir):
    return I.normalize_facts(_raw(spark, sf_dir), TYPES)[1]


def _graph(spark, sf_dir):
    """Facts joined with a graph result each: two names and a relation made from the numbers of the fact."""
    facts = written(I.normalize_facts(_raw(spark, sf_dir), TYPES)[0], "facts")
    raw, k = _raw(spark, sf_dir), F.col("chunk") * 7 + F.col("idx")
    name = lambda n: F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0"))
    entity = lambda n, kind: F.struct(n.alias("name"), F.lit(kind).alias("entity_type"))
    entities = F.array(entity(name(k % 12), "organization"), entity(F.upper(name(k % 12)), "person"), entity(F.concat(F.lit(" gadget  "), (k % 5).cast("string")), ""), entity(F.lit(""), "object"))
    relation = lambda s, r, o, c: F.struct(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"), c.alias("confidence"), F.lit(None).cast("string").alias("valid_from"))
    relations = F.array(relation(name(k % 12), "works-for", name(k % 12 + 1), (k % 10) / 10), relation(name(k % 12), "likes", F.upper(name(k % 12)), F.lit(0.9)), relation(name(k % 12), "part of", F.concat(F.lit("gadget "), (k % 5).cast("string")), F.lit(0.8)))
    graphs = raw.select("source_id", "chunk", F.lit(0).alias("pos"), F.col("idx").alias("index"), entities.alias("entities"), relations.alias("relations"))
    twice = graphs.unionByName(graphs.withColumns({"pos": F.lit(1), "relations": F.slice("relations", 1, 0)}))
    return written(I.graph_of_facts(facts, twice), "graph")


GRAPH = r"""facts as (select *, chunk * 7 + idx as k from ranked where n = 1),
rels as (select source_id, chunk, idx, 0 as pos, 'Supplier#' || lpad((k % 12)::varchar, 9, '0') as subject, 'WORKS_FOR' as relation, 'Supplier#' || lpad((k % 12 + 1)::varchar, 9, '0') as object, (k % 10) / 10.0 as confidence from facts where (k % 10) / 10.0 >= 0.7
  union all select source_id, chunk, idx, 2, 'Supplier#' || lpad((k % 12)::varchar, 9, '0'), 'PART_OF', 'gadget ' || (k % 5), 0.8 from facts),
names as (select lower(name) as key, name from (select distinct subject as name from rels union select object from rels union select 'Supplier#' || lpad((k % 12)::varchar, 9, '0') from facts union select 'gadget ' || (k % 5) from facts))"""


@query("fact_relations", T.oracle(RAW, GRAPH)("select source_id, chunk, idx, subject, relation, object, confidence::double as confidence from rels"))
def fact_relations(spark, sf_dir):
    return I.relations_of(_graph(spark, sf_dir)).select("source_id", "chunk", "idx", "subject", "relation", "object", "confidence")


@query("fact_entities", T.oracle(RAW, GRAPH)("select source_id, chunk, idx, lower(name) as key, count(*) as n from (select source_id, chunk, idx, 'Supplier#' || lpad((k % 12)::varchar, 9, '0') as name from facts union select source_id, chunk, idx, 'gadget ' || (k % 5) from facts union select source_id, chunk, idx, subject from rels union select source_id, chunk, idx, object from rels) group by all"))
def fact_entities(spark, sf_dir):
    return I.entities_of(_graph(spark, sf_dir)).groupBy("source_id", "chunk", "idx", casefold(F.col("name")).alias("key")).agg(F.count("*").alias("n"))


@query("entity_resolution_exact", T.oracle(RAW, GRAPH)("select key, case when s_suppkey is not null then s_suppkey end as entity_id, case when s_suppkey is not null then 'exact' else 'new' end as how from names left join supplier on lower(s_name) = key"))
def entity_resolution_exact(spark, sf_dir):
    out = I.resolve_entities(I.unique_entities(I.entities_of(_graph(spark, sf_dir))), _suppliers(spark, sf_dir))
    return out.select("key", F.when(F.col("how") == "exact", F.col("entity_id")).alias("entity_id"), "how")


def _suppliers(spark, sf_dir):
    return T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))


@query("edge_build", T.oracle(RAW, GRAPH)("select source_id, subject, relation, object, confidence::double as confidence from (select *, row_number() over (partition by source_id, subject, relation, object order by chunk, idx, pos) as n from rels) where n = 1"))
def edge_build(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    resolved = written(I.resolve_entities(I.unique_entities(I.entities_of(graph)), _suppliers(spark, sf_dir)), "resolved")
    names = resolved.select("entity_id", "name")
    edges = I.build_edges(I.relations_of(graph), resolved)
    a = names.select(F.col("entity_id").alias("source_entity"), F.col("name").alias("subject"))
    b = names.select(F.col("entity_id").alias("target_entity"), F.col("name").alias("object"))
    return edges.join(a, "source_entity").join(b, "target_entity").select("source_id", "subject", "relation", "object", "confidence")


@query("entity_resolution_fuzzy")
def entity_resolution_fuzzy(spark, sf_dir):
    names, parts = _turned_parts(spark, sf_dir)
    return I.resolve_entities(names, parts, I.entity_pool(names, parts))


def _turned_parts(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity_id")).select("entity_id", F.col("p_name").alias("name"))
    turned = parts.select(F.concat(F.split("name", " ")[1], F.lit(" "), F.split("name", " ")[0], F.lit("s")).alias("name"))
    return turned.select(casefold(F.col("name")).alias("key"), "name").distinct(), parts


_PARTS = """entities as (select min(p_partkey) as entity_id, p_name as name from part group by 2),
asked as (select distinct lower(split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) || 's') as key from entities)"""


@query("entity_name_pool", T.oracle(_PARTS, T.ALIKE)("select key, entity_id, round(cosine, 6) as cosine from (select *, row_number() over (partition by key order by round(cosine, 9) desc, entity_id) as n from alike where cosine >= 0.5 - 1e-9) where n <= 50"))
def entity_name_pool(spark, sf_dir):
    """The entities nearest to each part's name with its words turned round."""
    names, parts = _turned_parts(spark, sf_dir)
    return similar_names(names.select("key", F.col("key").alias("name")), parts).withColumn("cosine", F.round("cosine", 6))


@query("name_similarity")
def name_similarity(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", token_sort_ratio_column(F.col("s_name"), F.lit("supplier 000000011")).alias("ratio"))


@query("purge_partial", T.oracle(T.CHUNKS, T.CHUNK_MEMORIES)("""select 'chunk' as kind, chunk_id as id from chunks where not (source_id % 5 = 0 and sequence >= 1) union all select 'memory', doc_id from documents where doc_id not in
  (select memory_id from chunk_memories join chunks using (chunk_id) where source_id % 5 = 0 and sequence >= 1)"""))
def purge_partial(spark, sf_dir):
    tables = {"chunks": T.chunks(spark, sf_dir), "chunk_memories": T.chunk_memories(spark, sf_dir), "memories": T.memories(spark, sf_dir), "memory_entities": T.memory_entities(spark, sf_dir), "edges": T.edges(spark, sf_dir)}
    out = I.purge(tables, T.sources(spark, sf_dir).where("source_id % 5 = 0").select("source_id"), 1)
    return out["chunks"].select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")).unionByName(out["memories"].select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id")))


@query("memory_hints", T.oracle(T.MEMORIES)("""select query_id, count(*)::integer as n, sha256(string_agg(content, '|' order by rank)) as digest from (select query_id, vec_id as memory_id, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from
  (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, embeddings q where q.vec_id % 50 = 0) where score >= 0) where rank <= 10) join memories using (memory_id) where forgotten_at is null group by 1"""))
def memory_hints(spark, sf_dir):
    v = T.table(spark, sf_dir, "embeddings")
    out = I.memory_hints(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, T.memories(spark, sf_dir))
    return out.select("query_id", F.size("hints").alias("n"), F.sha2(F.array_join("hints", "|"), 256).alias("digest"))


@query("event_dates", f"""select k as id, strftime(case k % 6 when 0 then d - n when 1 then d + 7 * n when 2 then d - 30 * n when 3 then d + (case when ahead = 0 then 7 else ahead end)::integer
  when 4 then d + (case when ahead = 0 then -7 else 7 - ahead end)::integer else d + 1 end, '%Y-%m-%d') as day
  from (select *, (w - (isodow(d) - 1) + 7) % 7 as ahead from (select o_orderkey::bigint as k, (o_orderkey % 40 + 1)::integer as n, (o_orderkey % 7)::integer as w, o_orderdate::date as d from orders))""")
def event_dates(spark, sf_dir):
    """Wording made from each order, against the order's date. "Last <weekday>" counts forward, as the rule has it."""
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 40 + 1).cast("string")
    named = F.element_at(F.array(*map(F.lit, WEEKDAYS)), (k % 7 + 1).cast("int"))
    word = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    content = F.when(k % 6 == 0, word("we met ", n, " days ago")).when(k % 6 == 1, word("due in ", n, " weeks")).when(k % 6 == 2, word("it was ", n, " months ago")).when(k % 6 == 3, word("until next ", named)).when(k % 6 == 4, word("since last ", named)).otherwise(F.lit("Lunch tomorrow"))
    rows = T.table(spark, sf_dir, "orders").select(k.cast("long").alias("id"), content.alias("content"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return rows.select("id", F.date_format(infer_event_date(F.col("content"), F.col("at")), "yyyy-MM-dd").alias("day"))


@query("iso_dates", """select o_orderkey::bigint as id, epoch(case o_orderkey % 8 when 0 then d + to_hours(o_orderkey % 24) when 1 then d + to_hours(o_orderkey % 24) + to_minutes(30) when 2 then d + to_hours(o_orderkey % 24) - to_hours(2) when 3 then d when 6 then d + to_hours(o_orderkey % 24) + to_seconds(7) + to_milliseconds(250) end)::bigint as moment
  from (select *, date_trunc('day', o_orderdate) as d from orders)""")
def iso_dates(spark, sf_dir):
    """Each order's date as written in one of eight ways, three of which are no dates."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    hour = F.lpad((k % 24).cast("string"), 2, "0")
    said = F.when(k % 8 == 0, F.concat(day, F.lit("T"), hour, F.lit(":00:00"))).when(k % 8 == 1, F.concat(day, F.lit(" "), hour, F.lit(":30"))).when(k % 8 == 2, F.concat(day, F.lit("T"), hour, F.lit(":00:00+02:00"))).when(k % 8 == 3, F.concat(F.lit(" "), day))
    said = said.when(k % 8 == 4, "soon").when(k % 8 == 5, F.concat(F.lit("0000"), F.substring(day, 5, 6))).when(k % 8 == 6, F.concat(day, F.lit("T"), hour, F.lit(":00:07.250Z")))
    return T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(k.cast("long").alias("id"), F.unix_timestamp(parse_iso(said)).alias("moment"))
