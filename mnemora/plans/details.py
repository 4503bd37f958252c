"""Registered queries of single functions and smaller operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions import documents as N
from mnemora.functions import text as X
from mnemora.functions import times as D
from mnemora.functions import vectors as V
from mnemora.operators import ingestion as I
from mnemora.operators import knn as K
from mnemora.operators import lifecycle as C
from mnemora.operators import listing as L
from mnemora.operators import metrics as M
from mnemora.operators import ranking as R
from mnemora.operators import signals as S
from mnemora.plans import tables as T

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


mem, src, metric = T.oracle(T.MEMORIES), T.oracle(T.SOURCES, T.CHUNKS), T.oracle(T.METRICS)
DAY = 86_400


def _days_ago(n):
    return F.timestamp_seconds(F.unix_timestamp(T.at()) - n * DAY)


_AGO = f"(timestamp '{T.NOW}' - to_days(({{}})::int))"


# --- texts, times, vectors, JSON ---


@query("bounded_terms", r"""select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as digest from
  (select doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: length(w) between 1 and 64)[1:96] as w from documents)""")
def bounded_terms(spark, sf_dir):
    words = X.bounded_terms(F.col("text"))
    d = T.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", words.alias("w"))
    return d.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("escaped_documents", "select doc_id, md5(replace(replace(replace(replace(text, chr(0), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as digest from documents")
def escaped_documents(spark, sf_dir):
    return T.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(X.escape_tags(X.without_nul(F.col("text")))).alias("digest"))


@query("wanted_documents", "select doc_id from documents where contains(lower(text), 'the') and contains(lower(text), 'an') and not contains(lower(text), 'license')")
def wanted_documents(spark, sf_dir):
    lower = lambda *w: F.array(*map(F.lit, w))
    return T.table(spark, sf_dir, "documents", "doc_id", "text").where(X.matches_all(F.col("text"), lower("The", "an"), lower("License"))).select("doc_id")


@query("session_times", f"""select event_id, case when event_id % 3 < 2 then epoch(moment)::bigint end as reference, case when event_id % 3 < 2 then epoch(moment)::bigint else epoch(timestamp '{T.NOW}')::bigint end as recorded from
  (select event_id, case event_id % 3 when 0 then date_trunc('day', ts) else date_trunc('second', ts) end as moment from events)""")
def session_times(spark, sf_dir):
    form = lambda p: F.date_format(F.col("ts").cast("timestamp"), p)
    i = F.col("event_id")
    said = F.when(i % 3 == 0, form("yyyy-MM-dd")).when(i % 3 == 1, form("yyyy-MM-dd'T'HH:mm:ss")).otherwise("some day")
    t = T.table(spark, sf_dir, "events", "event_id", "ts").select("event_id", D.session_times(said, T.at()).alias("t"))
    return t.select("event_id", F.unix_timestamp("t.reference").alias("reference"), F.unix_timestamp("t.recorded").alias("recorded"))


@query("log_days", "select strftime(d, '%Y%m%d') as day from (select unnest(generate_series(min(ts)::date::timestamp, max(ts)::date::timestamp, interval 1 day)) as d from events)")
def log_days(spark, sf_dir):
    first, last = T.table(spark, sf_dir, "events", "ts").select(*[F.date_format(f("ts"), "yyyy-MM-dd") for f in (F.min, F.max)]).first()
    return spark.createDataFrame([(d,) for d in D.days_between(first, last)], "day string")


_Q = "list_transform(range(len(embedding)), lambda k: (k % 5 - 2)::double)"


@query("guarded_cosines", f"""select vec_id, round(c, 6) as score, round(least(1, greatest(0, 4 * c)), 6) as clamped from (select vec_id,
  list_inner_product(embedding::double[], {_Q}) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product({_Q}, {_Q})) + 1e-10) as c from embeddings)""")
def guarded_cosines(spark, sf_dir):
    asked = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: (k % 5 - 2).cast("double"))
    e = T.table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", V.guarded_cosine(asked, F.col("embedding").cast("array<double>")).alias("c"))
    return e.select("vec_id", F.round("c", 6).alias("score"), F.round(V.clamped(4 * F.col("c")), 6).alias("clamped"))


@query("string_fields", "select event_id, case when event_id % 2 = 0 then 's' || user_id end as session from events")
def string_fields(spark, sf_dir):
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    meta = F.concat(F.lit('{"session": '), F.when(i % 2 == 0, F.concat(F.lit('"s'), user, F.lit('"'))).otherwise(user), F.lit("}"))
    return T.table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", N.string_field(meta, "session").alias("session"))


@query("nested_records", "select event_id, json_extract_string(props, '$.k')::int as k from events")
def nested_records(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    raw = F.when(F.col("event_id") % 2 == 0, quoted).otherwise(F.col("props"))
    return T.table(spark, sf_dir, "events", "event_id", "props").select("event_id", N.log_record(raw, "k int")["k"].alias("k"))


@query("json_containment", "select event_id from events where event_id % 11 in (user_id, event_id % 7)")
def json_containment(spark, sf_dir):
    i = F.col("event_id")
    return T.table(spark, sf_dir, "events", "event_id", "user_id").where(N.contains_id(F.to_json(F.array("user_id", i % 7)), i % 11)).select("event_id")


# --- vectors, names, candidates ---


@query("vectors_by_id", "select vec_id, label, len(embedding)::int as dimensions from embeddings where vec_id in (select doc_id from documents where lang = 'de')")
def vectors_by_id(spark, sf_dir):
    ids = T.table(spark, sf_dir, "documents", "doc_id", "lang").where("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    return K.vectors_of(T.table(spark, sf_dir, "embeddings"), ids).select("vec_id", "label", F.size("embedding").alias("dimensions"))


@query("managed_topk", f"""select vec_id, row_number() over (order by score desc, vec_id) as rank from (select vec_id, list_inner_product(embedding::double[], {_Q})
  / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product({_Q}, {_Q}))) as score from embeddings) where score >= -1 order by score desc, vec_id limit 100""")
def managed_topk(spark, sf_dir):
    asked = [float(k % 5 - 2) for k in range(T.table(spark, sf_dir, "embeddings", "embedding").select(F.max(F.size("embedding"))).first()[0])]
    return K.nearest_managed(T.table(spark, sf_dir, "embeddings"), asked, 500, min_score=-1.0).select("vec_id", "rank")


@query("entity_terms", T.oracle(T.ENTITIES)(r"select entity_id from entities where list_has_any(string_split(regexp_replace(lower(name), '[^\w]+', ' ', 'g'), ' '), ['bolt', 'france', '000000007'])"))
def entity_terms(spark, sf_dir):
    return S.match_terms(T.entities(spark, sf_dir), "Bolt France 000000007").select("entity_id")


@query("rerank_pool", "select doc_id as memory_id, least(1.0, case when doc_id % 13 = 0 then 0 else n_chars / 2000.0 end)::double as base from documents where doc_id + 1 <= 300")
def rerank_pool(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents", "doc_id", "n_chars")
    relevance = F.when(F.col("doc_id") % 13 == 0, float("nan")).otherwise(F.col("n_chars") / 2000)
    rows = d.select(F.col("doc_id").alias("memory_id"), (F.col("doc_id") + 1).alias("place"))
    return R.rerank(rows, d.select(F.col("doc_id").alias("memory_id"), relevance.alias("relevance"))).select("memory_id", "base")


# --- batches, windows, links ---


@query("planned_batches", src("select source_id, least(mark, n) as start, least(mark + 2, n) as end, n - least(mark + 2, n) as remaining from (select s.source_id, mark::bigint as mark, count(chunk_id) as n from sources s left join chunks c using (source_id) group by 1, 2)"))
def planned_batches(spark, sf_dir):
    n = T.chunks(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("chunks"))
    progress = T.sources(spark, sf_dir).select("source_id", N.int_field(F.col("meta"), "ingest_next_sequence").alias("next_sequence")).join(n, "source_id", "left").na.fill(0, ["chunks"])
    return I.planned_batches(progress, 2)


def _hash_id(kind: str, *key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', '{kind}', {', '.join(key)})), 1, 15))::bigint"


def _window(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    window = c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("sequence"), F.col("text").alias("content"))
    facts = c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("sequence"), F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"), F.col("role").alias("content"), F.lit("fact").alias("memory_type"))
    empty = {"chunks": "chunk_id long, source_id long, sequence long", "memories": "memory_id long, content string, memory_type string", "chunk_memories": "chunk_id long, memory_id long"}
    first = I.persist_window({k: spark.createDataFrame([], v) for k, v in empty.items()}, window.where("sequence < 2"), facts)
    return I.persist_window({k: first[k] for k in empty}, window, facts)  # the first turns come in again


_KEYS = f"select conv_id as source_id, turn as sequence, idx, {_hash_id('chunk', 'conv_id', 'turn')} as chunk_id, {_hash_id('memory', 'conv_id', 'turn', 'idx')} as memory_id from conversations, (values (0), (1)) f(idx)"


@query("persisted_rows", _KEYS)
def persisted_rows(spark, sf_dir):
    return _window(spark, sf_dir)["rows"]


@query("persisted_counts", f"select 'chunks' as name, count(distinct chunk_id) as n from ({_KEYS}) union all select 'memories', count(distinct memory_id) from ({_KEYS}) union all select 'chunk_memories', count(distinct (chunk_id, memory_id)) from ({_KEYS})")
def persisted_counts(spark, sf_dir):
    after = _window(spark, sf_dir)
    one = lambda k: after[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n")
    return one("chunks").unionByName(one("memories")).unionByName(one("chunk_memories"))


# --- listings, sweeps, timings ---


@query("memory_page_next", mem("select memory_id, case when (select count(*) from memories where memory_type = 'fact') > 90 then 90 end::bigint as next_offset from memories where memory_type = 'fact' order by created_at desc, memory_id desc limit 30 offset 60"))
def memory_page_next(spark, sf_dir):
    rows = L.filtered(T.memories(spark, sf_dir), memory_type="fact")
    return L.offset_page(rows, "created_at", "memory_id", True, 30, 60).select("memory_id", "next_offset")


@query("key_list", T.oracle(T.SPACES_SQL)("select o_orderkey as key_id, s.name as space from orders left join spaces s on s.space_id = o_custkey % 8"))
def key_list(spark, sf_dir):
    keys = T.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("key_id"), (F.col("o_custkey") % 8).alias("space_id"))
    return L.key_list(keys, T.spaces(spark, sf_dir)).select("key_id", "space")


@query("invite_list", "select o_orderkey as invite_id, n_name as org, c_name as inviter from orders join customer on c_custkey = o_custkey join nation on n_nationkey = o_orderkey % 30")
def invite_list(spark, sf_dir):
    invites = T.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("invite_id"), F.col("o_custkey").alias("invited_by"), (F.col("o_orderkey") % 30).cast("int").alias("org_id"))
    orgs = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"))
    users = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return L.invite_list(invites, orgs, users).select("invite_id", "org", "inviter")


@query("billing_sweep", "select c_custkey as user_id, case when (c_custkey % 4 = 0 and c_custkey % 9 > 3) or (c_custkey % 5 = 0 and c_custkey % 7 > 3) then 'free' else 'pro' end as plan from customer")
def billing_sweep(spark, sf_dir):
    i = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer", "c_custkey").select(
        i.alias("user_id"), F.lit("pro").alias("plan"), F.when(i % 4 == 0, "past_due").otherwise("active").alias("status"), _days_ago(i % 9).alias("due_at"), F.when(i % 5 == 0, _days_ago(i % 7 - 3)).alias("grant_until")
    )
    return C.expired_plans(rows, T.at()).select("user_id", "plan")


_CUT = {
    "codes": "not (o_orderkey % 100 - 50 > 0 or o_orderkey % 7 = 0)",
    "tokens": f"not ({_AGO.format('o_orderkey % 60')} < {_AGO.format('30')} and {_AGO.format('o_orderkey % 50')} < {_AGO.format('30')})",
    "jobs": "not (o_orderstatus = 'F' and o_orderkey % 200 > 90)",
    "billing_events": "not (o_orderkey % 3 <> 0 and o_orderkey % 400 > 180)",
    "usage": f"not ({_AGO.format('o_orderkey % 800')}::date < {_AGO.format('400')}::date)",
}


@query("retention_sweeps", " union all ".join(f"select '{k}' as rule, o_orderkey as row_id from orders where {v}" for k, v in _CUT.items()))
def retention_sweeps(spark, sf_dir):
    i = F.col("o_orderkey")
    o = T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing")
    tables = {
        "codes": o.select(i, F.timestamp_seconds(F.unix_timestamp(T.at()) - (i % 100 - 50) * 60).alias("expires_at"), (i % 7 == 0).alias("used")),
        "tokens": o.select(i, _days_ago(i % 60).alias("expires_at"), _days_ago(i % 50).alias("revoked_at")),
        "jobs": o.select(i, status.alias("status"), _days_ago(i % 200).alias("created_at")),
        "billing_events": o.select(i, F.when(i % 3 != 0, T.at()).alias("processed_at"), _days_ago(i % 400).alias("received_at")),
        "usage": o.select(i, F.to_date(_days_ago(i % 800)).alias("date")),
    }
    out = None
    for name, df in C.retention_sweeps(tables, T.at()).items():
        part = df.select(F.lit(name).alias("rule"), i.alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("latencies_with_server", metric("""select user_id as query_id, count(*) as samples, quantile_disc(value, 0.5) as total_median, quantile_disc(case when event_id % 10 <> 0 then value / 2 end, 0.5) as took_median,
  count(*) filter (event_id % 10 = 0) as missing, count(*) as results, count(distinct stage) as sessions from metrics group by 1"""))
def latencies_with_server(spark, sf_dir):
    m = T.metrics(spark, sf_dir).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("request_id"), F.col("value").alias("total"), F.col("stage").alias("session_id"))
    timings = m.where("request_id % 10 <> 0").select("request_id", (F.col("total") / 2).alias("took"))
    return M.latencies_with_server(m.drop("session_id"), timings, m.select("query_id", "session_id"))


@query("outcome_counts", metric("select stage, version, status, sum(weight)::bigint as samples from metrics group by all"))
def outcome_counts(spark, sf_dir):
    return M.weighted_counts(T.metrics(spark, sf_dir), ["stage", "version", "status"])
