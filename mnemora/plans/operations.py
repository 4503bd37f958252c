"""Registered queries: audits, listings, logs, life cycle, rate windows and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions import documents as N
from mnemora.functions.text import decode_cursor
from mnemora.operators import audit as A
from mnemora.operators import lifecycle as C
from mnemora.operators import listing as L
from mnemora.operators import metrics as M
from mnemora.plans import tables as T
from mnemora.sources import logs, stores
from mnemora.streaming import jobs, windows

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


AUDIT = T.oracle(T.MEMORIES, T.SOURCES, T.CHUNKS, T.CHUNK_MEMORIES, T.MEMORY_ENTITIES, T.EDGES)
mem, src, job = T.oracle(T.MEMORIES), T.oracle(T.SOURCES, T.CHUNKS, T.SPACES_SQL), T.oracle(T.JOBS, T.SPACES_SQL)
ORPHAN = "memory_id not in (select memory_id from chunk_memories)"


@query("audit_orphans", AUDIT(f"select memory_id from memories where {ORPHAN}"))
def audit_orphans(spark, sf_dir):
    return A.orphans(T.memories(spark, sf_dir), T.chunk_memories(spark, sf_dir)).select("memory_id")


@query("audit_orphans_daily", AUDIT(f"select strftime(created_at, '%Y-%m-%d') as day, count(*) as orphans from memories where {ORPHAN} group by 1"))
def audit_orphans_daily(spark, sf_dir):
    out = A.orphans_by_day(T.memories(spark, sf_dir), T.chunk_memories(spark, sf_dir))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("audit_orphan_impact", AUDIT(f"select count(*) as total, count(*) filter (forgotten_at is null) as retrievable, (select count(*) from memory_entities where memory_id in (select memory_id from memories where {ORPHAN})) as entity_links, (select count(*) from edges where memory_id in (select memory_id from memories where {ORPHAN})) as edges from memories where {ORPHAN}"))
def audit_orphan_impact(spark, sf_dir):
    return A.orphan_impact(T.memories(spark, sf_dir), T.chunk_memories(spark, sf_dir), T.memory_entities(spark, sf_dir), T.edges(spark, sf_dir))


@query("audit_zero_chunks", src("select source_id from sources where status = 'completed' and source_id not in (select source_id from chunks)"))
def audit_zero_chunks(spark, sf_dir):
    return A.completed_without_chunks(T.sources(spark, sf_dir), T.chunks(spark, sf_dir)).select("source_id")


@query("audit_gaps", src("select source_id, max(sequence) as last, count(*) as n from chunks group by 1 having max(sequence) + 1 <> count(*)"))
def audit_gaps(spark, sf_dir):
    return A.sequence_gaps(T.chunks(spark, sf_dir))


@query("audit_checkpoint", src("select s.source_id, mark::int as mark, coalesce(n, 0) as n from sources s left join (select source_id, count(*) as n from chunks group by 1) c using (source_id) where mark > coalesce(n, 0)"))
def audit_checkpoint(spark, sf_dir):
    return A.checkpoint_ahead(T.sources(spark, sf_dir), T.chunks(spark, sf_dir))


@query("audit_status", src("select status, count(*) as sources, strftime(min(created_at), '%Y-%m-%d') as oldest from sources where status in ('pending', 'processing') group by 1"))
def audit_status(spark, sf_dir):
    return A.unfinished(T.sources(spark, sf_dir)).withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd"))


@query("audit_tombstones", src("select count(*) as spaces, epoch(min(deleted_at))::bigint as oldest from spaces where deleted_at is not null"))
def audit_tombstones(spark, sf_dir):
    return A.tombstones(T.spaces(spark, sf_dir)).withColumn("oldest", F.unix_timestamp("oldest"))


@query("ingestion_health", job("select status, count(*) as jobs, strftime(min(created_at), '%Y-%m-%d') as oldest, round(avg(epoch(completed_at) - epoch(started_at)), 6) as mean_seconds from jobs group by 1"))
def ingestion_health(spark, sf_dir):
    return A.ingestion_health(T.jobs(spark, sf_dir)).withColumns({"oldest": F.date_format("oldest", "yyyy-MM-dd"), "mean_seconds": F.round("mean_seconds", 6)})


# --- listings ---


@query("memory_page", mem("select memory_id, epoch(event_time)::bigint as event from memories where memory_type = 'fact' order by event_time desc nulls first, memory_id desc limit 30 offset 60"))
def memory_page(spark, sf_dir):
    return L.list_memories(T.memories(spark, sf_dir), "event_time", True, 30, 60, "fact").select("memory_id", F.unix_timestamp("event_time").alias("event"))


@query("keyset_page", mem("select memory_id, (select count(*) from memories where (created_at, memory_id) > (timestamp '2023-03-01', 5)) > 40 as has_more from memories where (created_at, memory_id) > (timestamp '2023-03-01', 5) order by created_at, memory_id limit 40"))
def keyset_page(spark, sf_dir):
    from datetime import datetime

    rows = T.memories(spark, sf_dir).withColumn("at", F.unix_timestamp("created_at"))
    start = int(datetime.fromisoformat("2023-03-01T00:00:00+00:00").timestamp())
    return L.keyset_page(rows, "at", "memory_id", (start, 5), 40).select("memory_id", "has_more")


@query("audit_feed", mem("select memory_id from memories where memory_id < 500 order by memory_id desc limit 50"))
def audit_feed(spark, sf_dir):
    return L.feed(T.memories(spark, sf_dir), "memory_id", 500).select("memory_id")


@query("ilike_filter", "select p_partkey from part where p_name ilike '%BOLT%'")
def ilike_filter(spark, sf_dir):
    return L.name_like(T.table(spark, sf_dir, "part"), "BOLT", "p_name").select("p_partkey")


@query("earliest_membership", "select c_custkey as user_id, (min((joined_at, group_id)))[2] as group_id from (select o_custkey as c_custkey, o_orderdate as joined_at, o_orderkey as group_id from orders) group by 1")
def earliest_membership(spark, sf_dir):
    m = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("joined_at"), F.col("o_orderkey").alias("group_id"))
    return L.earliest_membership(m, m.select("group_id").distinct()).select("user_id", "group_id")


@query("owner_names", mem("select memory_id, c_name as owner_name from memories left join customer on c_custkey = owner_user_id"))
def owner_names(spark, sf_dir):
    users = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return L.with_owner_names(T.memories(spark, sf_dir), users).select("memory_id", "owner_name")


@query("source_list", src("select source_id, s.name as space from sources join spaces s using (space_id) where status = 'failed' and content_type = 'markdown' and s.deleted_at is null"))
def source_list(spark, sf_dir):
    from mnemora.operators.scope import active_spaces

    rows = L.filtered(T.sources(spark, sf_dir), status="failed", content_type="markdown", space_id=None)
    return rows.join(active_spaces(T.spaces(spark, sf_dir)).select("space_id", F.col("name").alias("space")), "space_id").select("source_id", "space")


# --- life cycle ---


@query("active_job_counts", job("select space_id, count(*) as jobs from jobs where (status = 'pending' and created_at >= timestamp '2024-01-31 11:40:00') or (status = 'processing' and started_at >= timestamp '2024-01-31 11:40:00') group by 1"))
def active_job_counts(spark, sf_dir):
    return C.active_jobs(T.jobs(spark, sf_dir), T.at()).groupBy("space_id").agg(F.count("*").alias("jobs"))


@query("stale_jobs", job("select job_id, 'failed' as status from jobs where status = 'processing' and started_at < timestamp '2024-01-31 11:40:00'"))
def stale_jobs(spark, sf_dir):
    return C.stale_jobs(T.jobs(spark, sf_dir), T.at()).select("job_id", "status")


@query("retention_split", "select event_id from events where not (event_type = 'view' and ts < timestamp '2024-01-11 12:00:00')")
def retention_split(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return C.kept(e, "at", T.at(), 20, F.col("event_type") == "view").select("event_id")


_DUE = "((status in ('pending', 'processing') and updated_at < timestamp '2024-01-31 11:40:00') or (status = 'failed' and updated_at < timestamp '2024-01-31 11:58:00')) and created_at >= timestamp '2024-01-24 12:00:00' and space_id in (select space_id from spaces where deleted_at is null)"


@query("redrive_batches", src(f"""select source_id, action, case when action = 'redrive' then (row_number() over (partition by action, org_id, space_id, owner_user_id order by created_at, source_id) - 1) // 10 end as batch_no from
  (select *, case when owner_user_id is null then 'ownerless' when attempts >= 5 then 'exhausted' else 'redrive' end as action from sources where {_DUE})"""))
def redrive_batches(spark, sf_dir):
    return C.redrive_plan(T.sources(spark, sf_dir), T.spaces(spark, sf_dir), T.at()).select("source_id", "action", "batch_no")


@query("keyset_pages", """select page, count(*) as rows, min(us) as first_us, max(us) as last_us, (min((us, event_id)))[2] as first_id, (max((us, event_id)))[2] as last_id from (select *, (row_number() over (order by us, event_id) - 1) // 5000 as page
  from (select event_id, epoch_us(ts) as us from events)) group by 1""")
def keyset_pages(spark, sf_dir):
    """All pages of 5,000 that a scan of the events in order of time reads, from their cursors."""
    e = T.table(spark, sf_dir, "events", "event_id", "ts").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ends = L.keyset_pages(e, "us", "event_id")
    part = lambda c, k: decode_cursor(F.col(c))[k].cast("long")
    return ends.select("page", "rows", part("first_cursor", "at").alias("first_us"), part("last_cursor", "at").alias("last_us"), part("first_cursor", "key").alias("first_id"), part("last_cursor", "key").alias("last_id"))


@query("job_batches", src("select source_id, (row_number() over (partition by org_id, space_id order by source_id) - 1) // 10 as batch_no from sources"))
def job_batches(spark, sf_dir):
    return C.job_batches(T.sources(spark, sf_dir)).select("source_id", "batch_no")


@query("forget", AUDIT("select 'm' || memory_id as id from memories where forgotten_at is null and memory_id % 10 <> 1 union all select 'e' || edge_id from edges where forgotten_at is null and (memory_id is null or memory_id % 10 <> 1)"))
def forget(spark, sf_dir):
    m, e = C.forget(T.memories(spark, sf_dir), T.edges(spark, sf_dir), spark.range(1000).select(F.col("id").alias("memory_id")).where("memory_id % 10 = 1").unionByName(T.memories(spark, sf_dir).where("memory_id % 10 = 1").select("memory_id")), T.at())
    left = lambda df, prefix, key: df.where("forgotten_at is null").select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"))
    return left(m, "m", "memory_id").unionByName(left(e, "e", "edge_id"))


@query("finalizable_spaces", job("select space_id from spaces where deleted_at < timestamp '2024-01-01 12:00:00' and space_id not in (select space_id from jobs where status in ('pending', 'processing') and space_id <> 3)"))
def finalizable_spaces(spark, sf_dir):
    return C.finalizable_spaces(T.spaces(spark, sf_dir), T.jobs(spark, sf_dir).where("space_id <> 3"), T.at()).select("space_id")


@query("visibility_propagation", AUDIT("select memory_id, case when memory_id in (select memory_id from chunk_memories join chunks using (chunk_id) where source_id % 6 = 0) then 'org' else visibility end as visibility from memories"))
def visibility_propagation(spark, sf_dir):
    ids = T.sources(spark, sf_dir).where("source_id % 6 = 0").select("source_id")
    return C.propagated_visibility(T.memories(spark, sf_dir), ids, T.chunks(spark, sf_dir), T.chunk_memories(spark, sf_dir), "org").select("memory_id", "visibility")


@query("guarded_writes", "select o_orderkey as id from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n <= 12")
def guarded_writes(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    return C.guarded_insert(o.limit(0), o, "owner", "id", 12).select("id")


@query("upserted_events", "select user_id, max(event_id) as event_id from events group by 1")
def upserted_events(spark, sf_dir):
    e = T.table(spark, sf_dir, "events", "user_id", "event_id")
    return C.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("entitlements", """select c_custkey::bigint as org_id, case when c_custkey % 4 = 2 then (c_nationkey * 3)::varchar when c_nationkey < 5 then '50' else '100' end as searches, case when c_custkey % 4 = 1 then (c_custkey % 9)::varchar when c_nationkey < 5 then '7' else '5' end as spaces from customer""")
def entitlements(spark, sf_dir):
    """Customers as organisations: those of the first nations have a grant, half of all have overrides, some of them none that is an object."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    overrides = F.when(k % 4 == 1, F.to_json(F.struct((k % 9).alias("spaces")))).when(k % 4 == 2, F.to_json(F.struct((nation * 3).alias("searches")))).when(k % 4 == 3, "[]")
    plan = lambda searches, spaces: F.create_map(F.lit("searches"), F.lit(searches), F.lit("spaces"), F.lit(spaces))
    limits = N.entitlements(plan("100", "5"), overrides, F.when(nation < 5, plan("50", "7")))
    rows = T.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(k.cast("long").alias("org_id"), limits.alias("l"))
    return rows.select("org_id", F.col("l")["searches"].alias("searches"), F.col("l")["spaces"].alias("spaces"))


@query("json_fields", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) + 1 as merged, 0 as gone from events")
def json_fields(spark, sf_dir):
    e = T.table(spark, sf_dir, "events", "event_id", "props")
    k = N.int_field(F.col("props"), "k")
    return e.select("event_id", k.alias("k"), N.int_field(N.merged(F.col("props"), k=k + 1), "k").alias("merged"), N.int_field(N.without(F.col("props"), "k"), "k").cast("int").alias("gone"))


# --- logs, rates, evaluation ---


def _records(spark, sf_dir):
    return logs.as_records(T.table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props"))


@query("log_needle", "select event_id from events where event_type = 'error' and contains(event_type || user_id, 'error') and user_id::varchar like '%14%'")
def log_needle(spark, sf_dir):
    found = logs.search(_records(spark, sf_dir), {"event_type": "ERROR"}).where(F.contains(F.col("user_id").cast("string"), F.lit("14")))
    return found.select("event_id")


@query("log_count", "select event_type, count(*) as n from events where event_type in ('purchase') group by 1")
def log_count(spark, sf_dir):
    found = logs.search(_records(spark, sf_dir), ["purchase"])
    return logs.fields(found.select("record"), ["event_type", "absent"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("metric_rows", "select event_id::varchar as index1, 'search' as blob1, event_type as blob2, value as double1, 1 + event_id % 4 as weight from events")
def metric_rows(spark, sf_dir):
    return stores.metric_rows(T.metrics(spark, sf_dir), "search", ["stage"], ["value"], F.col("event_id"), F.col("weight"))


_RATE = "select user_id, '{0}' as scope, epoch(ts)::bigint // {1} * {1} as start, count(*) as n, greatest(count(*) - {2}, 0) as over from (select user_id, to_timestamp(floor(epoch(ts))) as ts from events) group by 1, 3"


@query("rate_windows", _RATE.format("hour", 3600, 2) + " union all " + _RATE.format("day", 86400, 3))
def rate_windows(spark, sf_dir):
    e = T.table(spark, sf_dir, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.rate_windows(e, {"hour": (3600, 2), "day": (86400, 3)}, "user_id")


@query("rate_admitted", "select event_id, row_number() over (partition by user_id, ts::date order by ts, event_id) <= 3 as admitted from events")
def rate_admitted(spark, sf_dir):
    e = T.table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.admitted(e, 86400, 3, "user_id", "event_id").select("event_id", "admitted")


@query("job_outcomes")
def job_outcomes(spark, sf_dir):
    action = F.when(F.col("n") == 1, "create").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "beat").otherwise("claim")
    from pyspark.sql import Window as W

    e = T.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    messages = e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("message_id"), action.alias("action"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return jobs.job_outcomes_batch(messages)


_MET = "select conv_id as query_id, turn + 1 as rank, text as content from conversations"


@query("retrieval_quality", f"""select query_id, round(n_found / 2.0, 6) as coverage, n_found = 2 as all_facts, coalesce(first = 1, false) as top1_relevant, round(coalesce(1.0 / first, 0), 6) as reciprocal_rank, coalesce(stale < first, false) as stale_before_fresh from
  (select query_id, (a is not null)::int + (b is not null)::int as n_found, least(a, b) as first, c as stale from (select query_id, min(rank) filter (contains(lower(content), 'thand')) as a, min(rank) filter (contains(lower(content), 'und')) as b, min(rank) filter (contains(lower(content), 'de ')) as c from ({_MET}) group by 1))""")
def retrieval_quality(spark, sf_dir):
    return _quality(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("coverage", "reciprocal_rank")})


def _quality(spark, sf_dir):
    results = T.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("text").alias("content"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("fact_id"), F.lit(i == 2).alias("stale"), F.lit(n).alias("needle")) for i, n in enumerate(("thand", "und", "de "))])).alias("f")
    return M.retrieval_quality(results, results.select("query_id").distinct().select("query_id", wanted).select("query_id", "f.*"))


@query("quality_by_variant", f"""select variant, count(*) as queries, round(avg(coverage), 6) as coverage, round(avg(all_facts::int), 6) as all_facts, round(avg(top1::int), 6) as top1_relevant, round(avg(rr), 6) as mrr, round(avg(sbf::int), 6) as stale_before_fresh from
  (select query_id % 4 as variant, n_found / 2.0 as coverage, n_found = 2 as all_facts, coalesce(first = 1, false) as top1, coalesce(1.0 / first, 0) as rr, coalesce(stale < first, false) as sbf from
  (select query_id, (a is not null)::int + (b is not null)::int as n_found, least(a, b) as first, c as stale from (select query_id, min(rank) filter (contains(lower(content), 'thand')) as a, min(rank) filter (contains(lower(content), 'und')) as b, min(rank) filter (contains(lower(content), 'de ')) as c from ({_MET}) group by 1))) group by 1""")
def quality_by_variant(spark, sf_dir):
    out = M.quality_means(_quality(spark, sf_dir).withColumn("variant", F.col("query_id") % 4), ["variant"])
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "all_facts", "top1_relevant", "mrr", "stale_before_fresh")})
