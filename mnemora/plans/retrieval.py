"""Registered queries: signals, fusion, scoring and selection, and the text expressions behind them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from mnemora.functions import text as X
from mnemora.functions import vectors as V
from mnemora.functions.stemmer import STOPPED
from mnemora.functions.times import MONTHS, WEEKDAYS, temporal_range_column
from mnemora.operators import ivf, knn
from mnemora.operators import ranking as R
from mnemora.operators import signals as S
from mnemora.operators.keyword import opened
from mnemora.operators.scope import hydrate
from mnemora.plans import search as P
from mnemora.plans import tables as T
from mnemora.sources.scratch import written
from mnemora.sources.stores import HashEmbedder, LexicalReranker

QUERIES, ORACLE_SQL = {}, {}
TEXT_QUERY = 'thing or erre or "tion of thed" the thly or ering -"thed thing"'
ASKED = "is the with still current"
WINDOW = (datetime(2023, 3, 1), datetime(2023, 9, 30, 23, 59, 59, 999000))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


COSINE = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
SEMANTIC = f"""near as (select memory_id, score from (select e.vec_id as memory_id, {COSINE} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q)
  where score >= 0.1 order by score desc, memory_id limit 50),
semantic as (select memory_id, row_number() over (order by score desc, memory_id) as rank, score from near join seen using (memory_id))"""
# which words have a stem of the query, written out; hits of both items with their first and last word; shortest stretches
_STEMS = r"""case when regexp_matches(w, '^thing(ly)?((ed|ing)(ly)?|e?s)?$') then 'thing' when regexp_matches(w, '^erre(ing(ly)?|ly((ed|ing)(ly)?)?)?$') then 'err' when regexp_matches(w, '^er(es?|(ed|ing)(ly)?)$') then 'ere'
  when regexp_matches(w, '^thly((ed|ing)(ly)?)?$') then 'thli' when regexp_matches(w, '^thed(ly((ed|ing)(ly)?)?)?$') then 'thed' when regexp_matches(w, '^tion(ly)?((ed|ing)(ly)?|e?s)?$') then 'tion' end"""
KEYWORD = rf"""placed as (select memory_id, unnest(w) as w, generate_subscripts(w, 1) as p from (select memory_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') as w from seen)),
stems as (select memory_id, p, {_STEMS} as stem from placed),
sizes as (select memory_id, count(*) as n from placed where length(w) <= 64 and w not in ({", ".join(f"'{w}'" for w in STOPPED.split())}) group by 1),
hits as (select memory_id, case when stem in ('thing', 'err') then 0 else 1 end as item, p as a, p as b from stems where stem in ('thing', 'err', 'ere', 'thli')
  union select x.memory_id, 0, x.p, y.p from stems x join stems y on x.memory_id = y.memory_id and y.p = x.p + 2 where x.stem = 'tion' and y.stem = 'thed'),
taken as (select memory_id, a as p from hits union select memory_id, b from hits),
banned as (select x.memory_id from stems x join stems y on x.memory_id = y.memory_id and y.p = x.p + 1 where x.stem = 'thed' and y.stem = 'thing'),
stretches as (select e.memory_id, e.b, least(max(h.a) filter (h.item = 0), max(h.a) filter (h.item = 1)) as a, count(distinct h.item) as items from (select distinct memory_id, b from hits) e join hits h on h.memory_id = e.memory_id and h.b <= e.b group by 1, 2),
covers as (select * from (select *, max(a) over (partition by memory_id order by b rows between unbounded preceding and 1 preceding) as before from stretches where items = 2) where before is null or a > before),
free as (select c.memory_id, c.a, c.b, c.b - c.a + 1 - count(*) as free from covers c join taken t on t.memory_id = c.memory_id and t.p between c.a and c.b group by 1, 2, 3),
dense as (select memory_id, sum(0.1::double / (1 + free)) / ln(1 + any_value(n)) as d from free join sizes using (memory_id) where memory_id not in (select memory_id from banned) group by 1),
rated as (select memory_id, d / (1 + d) as raw from dense order by raw desc, memory_id limit 100),
keyword as (select * from (select memory_id, row_number() over (order by raw desc, memory_id) as rank, raw / max(raw) over () as score from rated) where score >= 0.1 order by rank limit 50)"""
_MID = "(epoch_us(timestamp '2023-03-01') + epoch_us(timestamp '2023-09-30 23:59:59.999')) / 2"
_HALF = "((epoch_us(timestamp '2023-09-30 23:59:59.999') - epoch_us(timestamp '2023-03-01')) / 2e6)"
TEMPORAL = f"""timed as (select *, coalesce(event_time, recorded_at, created_at) as moment from seen),
dated as (select memory_id, abs(epoch_us(moment) - {_MID}) as distance from timed where moment between timestamp '2023-03-01' and timestamp '2023-09-30 23:59:59.999' order by distance, memory_id desc limit 50),
temporal as (select memory_id, row_number() over (order by distance, memory_id desc) as rank, 0.5 + 0.5 * greatest(0, least(1, 1 - distance / 1e6 / {_HALF})) as score from dated)"""
SIGNALS = """candidates as (select 'semantic' as signal, 0 as signal_no, * from semantic union all select 'keyword', 1, * from keyword union all select 'temporal', 3, * from temporal)"""
FUSED = """fused as (select *, row_number() over (order by round(fused, 12) desc, first_no, first_rank) as place from (select memory_id, sum(1.0 / (60 + rank)) as fused,
  (min((signal_no, rank)))[1] as first_no, (min((signal_no, rank)))[2] as first_rank from candidates group by 1))"""
BASED = "based as (select *, 1 - 0.9 * (place - 1) / greatest(count(*) over () - 1, 1) as base from fused)"
_AGE = "(epoch(timestamp '2024-01-31 12:00:00') - epoch({}))/86400.0"
SCORED = f"""scored as (select memory_id, place, base, content, recency, greatest(0, least(1, coalesce(importance_score, 0.5) * exp(-0.005 * {_AGE.format("created_at")}) + case when access_frequency = 0 then 0 else
    0.1 * sqrt(access_frequency) / (1 + sqrt(greatest({_AGE.format("last_accessed_at")}, 60 / 86400.0))) end)) as persistence,
  base * (1 + greatest(-0.3, least(0.3, 0.4 * (recency - 0.5) + case when is_update then 0.15 else -0.25 end))) as final from
  (select *, case when coalesce(event_time, case when is_update then recorded_at end) is null then 0.5 else greatest(0.2, least(1, 1 - {_AGE.format("coalesce(event_time, case when is_update then recorded_at end)")} / 365)) end as recency from
  (select b.place, b.base, s.*, regexp_matches(content, '(?i)\\b(changed?|correct(?:ed|s)?|no longer|now|replac(?:ed|es)|remain(?:s|ed)|still|instead|updat(?:ed|es?))\\b') as is_update from based b join seen s using (memory_id))))"""
base = T.oracle(T.MEMORIES, SEMANTIC, KEYWORD, TEMPORAL, SIGNALS, FUSED, BASED, SCORED)


def _vector(spark, sf_dir, vec_id=0):
    row = T.table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(F.col("vec_id") == vec_id).first()
    return list(row.embedding)


def _signals(spark, sf_dir, *names):
    """The named signals, or all of them."""
    m, v = T.memories(spark, sf_dir), T.table(spark, sf_dir, "embeddings")
    made = {
        "semantic": lambda: S.semantic_signal(m, v, _vector(spark, sf_dir), T.SCOPE),
        "keyword": lambda: S.keyword_signal(m, TEXT_QUERY, T.SCOPE, index=T.keyword_index(spark, sf_dir)),
        "temporal": lambda: S.temporal_signal(m, T.SCOPE, *WINDOW),
    }
    return {name: made[name]() for name in names or made}


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("semantic_topk", f"select vec_id, round(score, 6) as score, row_number() over (order by score desc, vec_id) as rank from (select e.vec_id, {COSINE} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q) where score >= 0.1 order by score desc, vec_id limit 50")
def semantic_topk(spark, sf_dir):
    return _rounded(knn.nearest(T.table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)), "score")


@query("semantic_batch_topk", f"select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, e.vec_id, {COSINE} as score from embeddings e, embeddings q where q.vec_id % 50 = 0) where score >= 0.1) where rank <= 10")
def semantic_batch_topk(spark, sf_dir):
    v = T.table(spark, sf_dir, "embeddings")
    return _rounded(knn.nearest_batch(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10), "score")


@query("semantic_mixed_topk", f"select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, e.vec_id, {COSINE} as score, q.vec_id // 50 % 7 as k, (q.vec_id % 100) / 200.0 as least from embeddings e, embeddings q where q.vec_id % 50 = 0) where score >= least) where rank <= k")
def semantic_mixed_topk(spark, sf_dir):
    v, i = T.table(spark, sf_dir, "embeddings"), F.col("vec_id")
    queries = v.where("vec_id % 50 = 0").select(i.alias("query_id"), "embedding", (F.floor(i / 50) % 7).cast("int").alias("k"), (i % 100 / 200).alias("min_score"))
    return _rounded(knn.nearest_batch(v, queries), "score")


@query("semantic_index_topk")
def semantic_index_topk(spark, sf_dir):
    """The 50 nearest of every 50th vector by the inverted-file index; exact says which of them the exact way finds too."""
    v = T.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = ivf.nearest_probed_batch(ivf.build(v), q)
    exact = knn.nearest_batch(v, q).select("query_id", "vec_id", F.lit(True).alias("exact"))
    return _rounded(found.join(exact, ["query_id", "vec_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False))), "score")


@query("semantic_scoped", base("select memory_id, rank, round(score, 6) as score from semantic"))
def semantic_scoped(spark, sf_dir):
    return _rounded(_signals(spark, sf_dir, "semantic")["semantic"], "score")


@query("vector_store_rewrite", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 5) as size from embeddings where vec_id % 3 <> 0 union all select vec_id, 1.0 from embeddings where vec_id % 6 = 0")
def vector_store_rewrite(spark, sf_dir):
    v = T.table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", V.doubles(F.col("embedding")).alias("embedding"))
    thirds = v.where("vec_id % 3 = 0")
    unit = thirds.where("vec_id % 6 = 0").select("vec_id", V.normalized(F.col("embedding")).alias("embedding"))
    out = knn.upserted(knn.deleted(v, thirds.select("vec_id")), unit)
    return out.select("vec_id", F.round(V.norm(F.col("embedding")) * V.norm(F.col("embedding")), 5).alias("size"))


@query("keyword_index", T.oracle(T.MEMORIES)(rf"""select memory_id, count(*)::integer as n_words, sum(p - 1)::bigint as places from (select memory_id, unnest(w) as w, generate_subscripts(w, 1) as p from
  (select memory_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') as w from memories)) where length(w) <= 64 and w not in ({", ".join(f"'{w}'" for w in STOPPED.split())}) group by 1"""))
def keyword_index(spark, sf_dir):
    """What the index, once written, holds of each memory."""
    rows = opened(T.keyword_index(spark, sf_dir))
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)
    return rows.groupBy("memory_id").agg(F.first("n_words").alias("n_words"), F.sum(total).alias("places"))


@query("keyword_match_rank", base("select memory_id, rank, round(score, 6) as score from keyword"))
def keyword_match_rank(spark, sf_dir):
    return _rounded(_signals(spark, sf_dir, "keyword")["keyword"], "score")


@query("temporal_window_rank", base("select memory_id, rank, round(score, 6) as score from temporal"))
def temporal_window_rank(spark, sf_dir):
    return _rounded(_signals(spark, sf_dir, "temporal")["temporal"], "score")


@query("rrf_fusion", base("select memory_id, round(fused, 9) as fused, place from fused"))
def rrf_fusion(spark, sf_dir):
    return R.rrf(R.tagged(_signals(spark, sf_dir))).withColumn("fused", F.round("fused", 9))


@query("rank_remap", base("select memory_id, place, round(base, 6) as base from based"))
def rank_remap(spark, sf_dir):
    return _rounded(R.rank_remap(R.rrf(R.tagged(_signals(spark, sf_dir)))).select("memory_id", "place", "base"), "base")


@query("candidate_lookup", base("select memory_id, arg_max(signal, (score, -signal_no)) as signal, arg_max(rank, (score, -signal_no)) as rank, round(max(score), 6) as score, string_agg(signal, ',' order by signal_no) as signals from candidates group by 1"))
def candidate_lookup(spark, sf_dir):
    out = R.candidate_lookup(R.tagged(_signals(spark, sf_dir)))
    return _rounded(out, "score").withColumn("signals", F.array_join("signals", ","))


def _scored(spark, sf_dir):
    based = written(R.rank_remap(R.rrf(R.tagged(_signals(spark, sf_dir)))), "based")  # at most the signals' pools
    rows = based.join(hydrate(T.memories(spark, sf_dir), based, T.SCOPE), "memory_id")
    return R.final_score(rows, F.lit(ASKED), T.at())


@query("final_score", base("select memory_id, place, round(recency, 6) as recency, round(persistence, 6) as persistence, round(final, 6) as final from scored"))
def final_score(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).select("memory_id", "place", "recency", "persistence", "final"), "recency", "persistence", "final")


@query("session_diverse_topk", base("""select memory_id, position, round(adjusted, 6) as adjusted from (select *, row_number() over (order by adjusted desc, n) as position from (select *, final - 0.1 * (row_number() over (partition by own order by n) - 1) as adjusted
  from (select *, row_number() over (order by final desc, place) as n, case when memory_id % 5 = 0 then 'm' || memory_id else 's' || memory_id % 7 end as own from scored))) where position <= 10"""))
def session_diverse_topk(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("session_id", F.when(F.col("memory_id") % 5 != 0, F.col("memory_id") % 7))
    return _rounded(R.session_diverse(rows, 10).select("memory_id", "position", "adjusted"), "adjusted")


@query("relevance_floor", base("select memory_id, round(base, 6) as base from scored where base >= 0.4"))
def relevance_floor(spark, sf_dir):
    return _rounded(R.relevance_floor(_scored(spark, sf_dir), "rerank-2.5").select("memory_id", "base"), "base")


@query("fail_open_filter", base("select memory_id from seen where memory_type = 'fact' and (importance_score > 0.5 or not exists (select 1 from seen where memory_type = 'fact' and importance_score > 0.5)) union all select memory_id from seen where memory_type = 'event'"))
def fail_open_filter(spark, sf_dir):
    from mnemora.operators.scope import active, scoped

    rows = active(scoped(T.memories(spark, sf_dir), T.SCOPE)).where("memory_type <> 'preference'")
    test = F.when(F.col("memory_type") == "fact", F.col("importance_score") > 0.5).otherwise(F.lit(False))
    return R.in_range_if_any(rows, test, ["memory_type"]).select("memory_id")


# greedy, a choice a step: each step's value is over what has been taken before
MMR = """with recursive near as (select * from (select *, row_number() over (partition by query_id order by final desc, memory_id) as n from (select q.vec_id as query_id, e.vec_id as memory_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as final
  from embeddings e, embeddings q where q.vec_id % 50 = 0) where final >= 0.1) where n <= 40),
free as (select * from (select *, final / max(final) over (partition by query_id) as share from near) where share >= 0.3),
pairs as (select a.query_id, a.memory_id as a, b.memory_id as b, list_cosine_similarity(v.embedding::double[], w.embedding::double[]) as alike from free a join free b using (query_id) join embeddings v on v.vec_id = a.memory_id join embeddings w on w.vec_id = b.memory_id),
step as (select distinct query_id, 0::bigint as position, null::bigint as memory_id, []::bigint[] as taken from free
  union all select query_id, position + 1, best, list_append(taken, best) from (select query_id, position, taken, arg_max(memory_id, (value, final, -memory_id)) as best from (
    select s.query_id, s.position, s.taken, f.memory_id, f.final, 0.6 * f.share - 0.4 * greatest(0, coalesce(max(p.alike), 0)) as value from step s join free f on f.query_id = s.query_id and not list_contains(s.taken, f.memory_id)
      left join pairs p on p.query_id = f.query_id and p.a = f.memory_id and list_contains(s.taken, p.b) where s.position < 10 group by s.query_id, s.position, s.taken, f.memory_id, f.final, f.share) group by query_id, position, taken))
select query_id, memory_id, position from step where position > 0"""


@query("mmr", MMR)
def mmr(spark, sf_dir):
    v = T.table(spark, sf_dir, "embeddings")
    near = knn.nearest_batch(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 40)
    return R.mmr(near.select("query_id", F.col("vec_id").alias("memory_id"), F.col("score").alias("final")), v, 10)


@query("search")
def search(spark, sf_dir):
    request = P.SearchRequest("what changed with the supplier last year", tuple(_vector(spark, sf_dir)), limit=10)
    out = P.search(T.graph_tables(spark, sf_dir), T.table(spark, sf_dir, "embeddings"), request, T.SCOPE, T.TODAY, LexicalReranker())
    return out.select("memory_id", "position", F.round("final", 6).alias("final"), F.array_join("signals", ",").alias("signals"))


@query("touch", base("select memory_id, access_frequency + (memory_id in (select memory_id from keyword))::int as access_frequency, epoch(case when memory_id in (select memory_id from keyword) then timestamp '2024-01-31 12:00:00' else last_accessed_at end)::bigint as accessed from memories"))
def touch(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return R.touched(m, _signals(spark, sf_dir, "keyword")["keyword"], T.at()).select("memory_id", "access_frequency", F.unix_timestamp("last_accessed_at").alias("accessed"))


# --- expressions ---

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query("tokenized_documents", rf"select doc_id, len(t) as n, list_sort(t)[1] as first, list_sort(t)[-1] as last from (select doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 and w not in ({_STOP}))) as t from documents)")
def tokenized_documents(spark, sf_dir):
    t = F.array_sort(X.tokenize(F.coalesce("text", F.lit(""))))
    return T.table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"))


@query("token_overlap", rf"select c.conv_id, c.turn, len(list_intersect(a, b)) as overlap from (select conv_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 and w not in ({_STOP}))) as a from conversations) c, (select ['de', 'und', 'thand', 'lich', 'er'] as b) q")
def token_overlap(spark, sf_dir):
    asked = F.array(*map(F.lit, ["de", "und", "thand", "lich", "er"]))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_intersect(X.tokenize(F.col("text")), asked)).cast("long").alias("overlap"))


@query("text_keys", r"select doc_id, ceil(length(text) / 4)::bigint as tokens, substr(sha256(text), 1, 32) as key, trim(regexp_replace(regexp_replace(upper(replace(source, '-', '_')), '\s+', '_', 'g'), '_+', '_', 'g')) as relation, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents where text is not null")
def text_keys(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("tokens"), X.content_key(F.col("text")).alias("key"), X.relation_name(F.col("source")).alias("relation"), X.slug(F.col("source")).alias("slug"))


@query("formatted_sessions", "select conv_id, sha256(string_agg(role || ': ' || text, chr(10) order by turn)) as digest, count(*) as turns from conversations group by 1")
def formatted_sessions(spark, sf_dir):
    g = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("t"), F.count("*").alias("turns"))
    return g.select("conv_id", F.sha2(X.format_messages(F.col("t")), 256).alias("digest"), "turns")


@query("dated_documents", T.oracle(T.MEMORIES)("""select memory_id, coalesce('[Date: ' || strftime(event_time, '%B %d, %Y (%Y-%m-%d)') || '] ', '') || '[Recorded: ' || strftime(recorded_at, '%B %d, %Y (%Y-%m-%d)') || '] ' || memory_type as shown,
  memory_type || coalesce(' (happened in ' || strftime(event_time, '%B %Y') || ')', '') as enriched from memories"""))
def dated_documents(spark, sf_dir):
    kind, event = F.col("memory_type"), F.col("event_time")
    return T.memories(spark, sf_dir).select("memory_id", X.dated_document(kind, event, F.col("recorded_at")).alias("shown"), X.enriched(kind, event).alias("enriched"))


@query("cursor_round_trip", "select event_id, epoch_us(ts) as moment from events")
def cursor_round_trip(spark, sf_dir):
    e = T.table(spark, sf_dir, "events", "event_id", "ts").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    back = X.decode_cursor(X.encode_cursor(F.col("us"), F.col("event_id")))
    return e.select(back["key"].cast("long").alias("event_id"), back["at"].cast("long").alias("moment"))


@query("query_intents", "select p_partkey::bigint as query_id, ['PREFERENCE', 'ENTITY_LOOKUP', 'PERSONAL', 'FACTUAL'][p_partkey % 4 + 1] as name, [0.9, 0.8, 0.85, 0.0][p_partkey % 4 + 1]::double as confidence from part")
def query_intents(spark, sf_dir):
    """A question about each part."""
    k = F.col("p_partkey")
    asked = F.when(k % 4 == 0, "what is my favorite ").when(k % 4 == 1, "who is the maker of ").when(k % 4 == 2, "do you remember ").otherwise("explain ")
    q = T.table(spark, sf_dir, "part").select(k.cast("long").alias("query_id"), F.concat(asked, F.col("p_name")).alias("query"))
    return q.select("query_id", X.intent(F.col("query")).alias("i")).select("query_id", "i.name", "i.confidence")


_NOW = "date '2024-01-31'"


@query("temporal_ranges", f"""select k as query_id, epoch_ms(a::timestamp)::bigint as start, epoch_ms(b::timestamp)::bigint + 86399999 as "end" from (select k, case k % 7 when 0 then {_NOW} - n when 1 then m when 2 then m when 3 then {_NOW} - 7 * n when 4 then {_NOW} - back when 5 then make_date(y, 1, 1) else {_NOW} - case when back = 0 then 7 else back end end as a,
  case k % 7 when 0 then {_NOW} - n when 1 then {_NOW} when 2 then last_day(m) when 3 then {_NOW} when 4 then {_NOW} - back when 5 then make_date(y, 12, 31) else {_NOW} - case when back = 0 then 7 else back end end as b
  from (select *, make_date(y, (k % 12 + 1)::integer, 1) as m, (2 - w + 7) % 7 as back from (select o_orderkey::bigint as k, (o_orderkey % 40 + 2)::integer as n, (o_orderkey // 7 % 7)::integer as w, (2001 + o_orderkey % 22)::integer as y from orders)))""")
def temporal_ranges(spark, sf_dir):
    """Wording made from each order's key, as asked on a Wednesday."""
    k = F.col("o_orderkey")
    n, year = (k % 40 + 2).cast("string"), (2001 + k % 22).cast("string")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), (k % 12 + 1).cast("int"))
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), (F.floor(k / 7) % 7 + 1).cast("int"))
    word = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    query = F.when(k % 7 == 0, word("what happened ", n, " days ago")).when(k % 7 == 1, word("orders since ", month, " ", year)).when(k % 7 == 2, word("trips in ", month, " ", year)).when(k % 7 == 3, word("over the last ", n, " weeks"))
    query = query.when(k % 7 == 4, word("who came on ", day)).when(k % 7 == 5, word("report for ", year)).otherwise(word("calls last ", day))
    rows = T.table(spark, sf_dir, "orders").select(k.cast("long").alias("query_id"), query.alias("query"))
    return rows.select("query_id", temporal_range_column(F.col("query"), T.TODAY).alias("r")).select("query_id", "r.start", "r.end")


@query("embedded_documents")
def embedded_documents(spark, sf_dir):
    e = HashEmbedder(32).column(F.col("text"))
    return T.table(spark, sf_dir, "documents").select("doc_id", e.alias("v")).select("doc_id", F.round(V.norm(F.col("v")), 6).alias("size"))
