"""Registered queries: usage analytics and metric aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions.times import period
from mnemora.operators import analytics as A
from mnemora.operators import metrics as M
from mnemora.plans import tables as T

START, END, PREVIOUS_START, PREVIOUS_END = period(T.TODAY, 30)
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


daily, metric = T.oracle(T.DAILY), T.oracle(T.METRICS)
SUMS = ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in A.COUNTERS)
IN = f"date between date '{START}' and date '{END}'"


@query("usage_summary", daily(f"""select coalesce(c.sources_ingested, 0) as sources_ingested, c.sources_failed, c.memories_created, c.tokens_ingested, c.search_queries,
  p.sources_ingested as previous_sources_ingested, p.sources_failed as previous_sources_failed, p.memories_created as previous_memories_created, p.tokens_ingested as previous_tokens_ingested, p.search_queries as previous_search_queries
  from (select {SUMS} from daily where {IN}) c, (select {SUMS} from daily where date between date '{PREVIOUS_START}' and date '{PREVIOUS_END}') p"""))
def usage_summary(spark, sf_dir):
    return A.two_periods(A.scoped_usage(T.daily_usage(spark, sf_dir), 1), (START, END), (PREVIOUS_START, PREVIOUS_END))


@query("space_usage", daily("select " + SUMS + " from daily where space_id = 2 and date between date '2024-01-05' and date '2024-01-20'"))
def space_usage(spark, sf_dir):
    return A.period_totals(A.scoped_usage(T.daily_usage(spark, sf_dir), 1, 2), "2024-01-05", "2024-01-20")


@query("daily_gapfilled", daily(f"select strftime(g.d, '%Y-%m-%d') as day, {SUMS} from (select unnest(generate_series(date '{START}', date '{END}', interval 1 day))::date as d) g left join daily on date = g.d group by 1"))
def daily_gapfilled(spark, sf_dir):
    return A.daily_series(T.daily_usage(spark, sf_dir), START, END).withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


@query("usage_by_content_type", "select event_type as content_type, count(*) as count from events group by 1")
def usage_by_content_type(spark, sf_dir):
    counts = T.table(spark, sf_dir, "events", "event_type", "user_id").groupBy(F.col("event_type").alias("content_type"), "user_id").agg(F.count("*").alias("count"))
    return A.by_key(counts, "content_type")


@query("usage_by_space", T.oracle(T.DAILY, T.SPACES_SQL)(f"select d.space_id, s.name, {SUMS} from daily d left join spaces s on s.space_id = d.space_id and s.deleted_at is null where s.name is not null group by 1, 2"))
def usage_by_space(spark, sf_dir):
    return A.by_space(T.daily_usage(spark, sf_dir), T.spaces(spark, sf_dir))


@query("month_to_date", daily("select coalesce(sum(tokens_ingested), 0)::bigint as tokens_ingested from daily where date >= date '2024-01-01' and date <= date '2024-01-31'"))
def month_to_date(spark, sf_dir):
    return A.month_to_date(T.daily_usage(spark, sf_dir), T.at(), "tokens_ingested")


@query("quota_status", daily("""select org_id, coalesce(used, 0)::bigint as used, lim as limit, case when lim = -1 then -1 else greatest(lim - coalesce(used, 0), 0) end::bigint as remaining,
  lim <> -1 and coalesce(used, 0) + 10 > lim as exceeded from (values (1, 100::bigint), (2, 5::bigint), (3, -1::bigint)) l(org_id, lim) left join (select org_id, sum(search_queries) as used from daily where date >= date '2024-01-01' and date <= date '2024-01-31' group by 1) using (org_id)"""))
def quota_status(spark, sf_dir):
    limits = spark.createDataFrame([(1, 100), (2, 5), (3, -1)], "org_id int, limit long")
    return A.quota_status(T.daily_usage(spark, sf_dir), limits, "search_queries", T.at(), 10)


@query("active_distinct", daily("""select count(distinct user_id) filter (date between date '2024-01-15' and date '2024-01-31') as user_id_now, count(distinct user_id) filter (date between date '2024-01-01' and date '2024-01-14') as user_id_before,
  count(distinct space_id) filter (date between date '2024-01-15' and date '2024-01-31') as space_id_now, count(distinct space_id) filter (date between date '2024-01-01' and date '2024-01-14') as space_id_before from daily where search_queries > 0"""))
def active_distinct(spark, sf_dir):
    windows = {"now": ("2024-01-15", "2024-01-31"), "before": ("2024-01-01", "2024-01-14")}
    return A.active_counts(T.daily_usage(spark, sf_dir).where("search_queries > 0"), windows, ["user_id", "space_id"])


_NEW = "select '{0}' as \"table\", count(*) as total, count(*) filter (created_at >= timestamp '2024-01-15' and created_at < timestamp '2024-01-31') as now, count(*) filter (created_at >= timestamp '2023-12-30' and created_at < timestamp '2024-01-15') as before from {0}"


@query("admin_overview", T.oracle(T.MEMORIES, T.SOURCES, T.JOBS)(" union all ".join(_NEW.format(t) for t in ("memories", "sources", "jobs"))))
def admin_overview(spark, sf_dir):
    windows = {"now": (T.at("2024-01-15"), T.at("2024-01-31")), "before": (T.at("2023-12-30"), T.at("2024-01-15"))}
    return A.new_rows({"memories": (T.memories(spark, sf_dir), "created_at"), "sources": (T.sources(spark, sf_dir), "created_at"), "jobs": (T.jobs(spark, sf_dir), "created_at")}, windows)


@query("backfill_full_join", T.oracle(T.SOURCES, T.MEMORIES)("""select org_id, user_id, space_id, strftime(date, '%Y-%m-%d') as day, coalesce(ok, 0) as sources_ingested, coalesce(bad, 0) as sources_failed, coalesce(made, 0) as memories_created from
  (select org_id, owner_user_id as user_id, space_id, created_at::date as date, count(*) filter (status = 'completed') as ok, count(*) filter (status = 'failed') as bad from sources group by all) s
  full join (select org_id, owner_user_id as user_id, space_id, created_at::date as date, count(*) as made from memories group by all) m using (org_id, user_id, space_id, date) where date < date '2024-01-28'"""))
def backfill_full_join(spark, sf_dir):
    s = T.sources(spark, sf_dir).select("org_id", F.col("owner_user_id").alias("user_id"), "space_id", F.to_date("created_at").alias("date"), "status")
    m = T.memories(spark, sf_dir).select("org_id", F.col("owner_user_id").alias("user_id"), "space_id", F.to_date("created_at").alias("date"))
    return A.backfill(s, m, F.lit("2024-01-28").cast("date")).withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


@query("usage_rollup", daily("""select org_id, user_id, space_id, strftime(date, '%Y-%m-%d') as day, sum(sources_ingested)::bigint as sources_ingested, sum(sources_failed)::bigint as sources_failed, sum(memories_created)::bigint as memories_created,
  sum(tokens_ingested)::bigint as tokens_ingested, sum(search_queries)::bigint as search_queries from (select * from daily union all select * from daily where space_id = 1) group by all"""))
def usage_rollup(spark, sf_dir):
    d = T.daily_usage(spark, sf_dir)
    return A.rollup(d, d.where("space_id = 1")).withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


@query("source_delta", T.oracle(T.SOURCES, T.CHUNKS, T.CHUNK_MEMORIES)("""select org_id, owner_user_id as user_id, space_id, strftime(created_at, '%Y-%m-%d') as day, count(*) filter (status = 'completed') as sources_ingested, count(*) filter (status = 'failed') as sources_failed,
  coalesce(sum(made), 0)::bigint as memories_created, coalesce(sum(token_count) filter (status = 'completed'), 0)::bigint as tokens_ingested
  from sources left join (select source_id, count(distinct memory_id) as made from chunks join chunk_memories using (chunk_id) group by 1) using (source_id) group by all"""))
def source_delta(spark, sf_dir):
    s = T.sources(spark, sf_dir).withColumns({"user_id": F.col("owner_user_id"), "date": F.to_date("created_at")})
    out = A.source_delta(s, T.chunks(spark, sf_dir), T.chunk_memories(spark, sf_dir))
    return out.withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date", "search_queries")


@query("job_rollup", T.oracle(T.SOURCES)("""select source_id // 10 as job_id, case when count(*) filter (status = 'failed') = 0 then 'completed' when count(*) filter (status = 'failed') = count(*) then 'failed' else 'partial' end as status,
  count(*) as sources, count(*) filter (status = 'failed') as failed from sources group by 1"""))
def job_rollup(spark, sf_dir):
    return A.job_status(T.sources(spark, sf_dir).withColumn("job_id", F.floor(F.col("source_id") / 10)))


# --- metrics ---


@query("weighted_mean", metric("select stage, sum(weight)::bigint as samples, round(sum(value * weight) / sum(weight), 6) as mean from metrics group by 1"))
def weighted_mean(spark, sf_dir):
    return M.weighted_mean(["stage"], T.metrics(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


_WQ = """select {k}, max(allw)::bigint as samples, min(value) filter (run >= 0.5 * allw) as p50, min(value) filter (run >= 0.95 * allw) as p95, min(value) filter (run >= 0.99 * allw) as p99
  from (select *, sum(weight) over (partition by {k} order by value, event_id) as r0, sum(weight) over (partition by {k} order by value) as run, sum(weight) over (partition by {k}) as allw from metrics) group by {k}"""


@query("weighted_quantiles", metric(_WQ.format(k="stage, version")))
def weighted_quantiles(spark, sf_dir):
    return M.weighted_quantiles(T.metrics(spark, sf_dir), ["stage", "version"])


@query("weighted_error_rate", metric("select version, round(100.0 * coalesce(sum(weight) filter (status >= 400), 0) / sum(weight), 6) as error_rate from metrics group by 1"))
def weighted_error_rate(spark, sf_dir):
    return M.weighted_share(T.metrics(spark, sf_dir), ["version"], F.col("status") >= 400, "error_rate").withColumn("error_rate", F.round("error_rate", 6))


@query("throttle_share", metric("select user_id, round(100.0 * coalesce(sum(weight) filter (status = 429), 0) / sum(weight), 6) as throttled from metrics group by 1"))
def throttle_share(spark, sf_dir):
    return M.weighted_share(T.metrics(spark, sf_dir), ["user_id"], F.col("status") == 429, "throttled").withColumn("throttled", F.round("throttled", 6))


@query("rejections_by_reason", metric("select status, stage, sum(weight)::bigint as samples from metrics where status >= 400 group by all"))
def rejections_by_reason(spark, sf_dir):
    return M.weighted_counts(T.metrics(spark, sf_dir).where("status >= 400"), ["status", "stage"])


_CELL = "case when {0} = 0 then case when {1} = 0 then 0.0 end else ({1} - {0}) / {0} * 100 end"


@query("cohort_delta", metric("""select coalesce(b.stage, a.stage) as stage, coalesce(b.samples, 0)::bigint as before_samples, coalesce(a.samples, 0)::bigint as after_samples,
  case when coalesce(b.samples, 0) >= 100 and coalesce(a.samples, 0) >= 100 then round(""" + _CELL.format("b.p50", "a.p50") + """, 6) end as p50_delta,
  case when coalesce(b.samples, 0) >= 100 and coalesce(a.samples, 0) >= 100 then round(""" + _CELL.format("b.p95", "a.p95") + """, 6) end as p95_delta from
  (""" + _WQ.format(k="stage").replace("from metrics", "from metrics where version = 'v0'") + ") b full join (" + _WQ.format(k="stage").replace("from metrics", "from metrics where version = 'v1'") + ") a on a.stage = b.stage"))
def cohort_delta(spark, sf_dir):
    m = T.metrics(spark, sf_dir)
    before, after = (M.weighted_quantiles(m.where(F.col("version") == v), ["stage"]) for v in ("v0", "v1"))
    out = M.cohort_delta(before, after, ["stage"], ["p50", "p95"])
    return out.withColumns({c: F.round(c, 6) for c in ("p50_delta", "p95_delta")})


@query("min_sample_gate", metric("select user_id, sum(weight)::bigint as samples, case when sum(weight) >= 170 then round(sum(value * weight) / sum(weight), 6) end as mean from metrics group by 1"))
def min_sample_gate(spark, sf_dir):
    rows = M.weighted_mean(["user_id"], T.metrics(spark, sf_dir))
    return rows.withColumn("mean", M.enough(F.round("mean", 6), F.col("samples"), 170))


@query("latency_summary", metric("select stage, status, count(*) as n, min(value) as min, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as max, round(avg(value), 6) as mean, round(quantile_cont(value, 0.9), 6) as p90_linear from metrics group by all"))
def latency_summary(spark, sf_dir):
    out = M.latency_summary(T.metrics(spark, sf_dir), ["stage", "status"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p90_linear")})


@query("upper_median", metric("select user_id, value as upper_median from (select user_id, value, row_number() over (partition by user_id order by value) as n, count(*) over (partition by user_id) as c from metrics) where n = c // 2 + 1"))
def upper_median(spark, sf_dir):
    return M.upper_median(T.metrics(spark, sf_dir), ["user_id"], "value")


@query("spans_per_window", metric("""select epoch(time_bucket(interval 6 hours, ts, timestamp '1970-01-01'))::bigint as start, stage, count(*) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean,
  quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, round(count(*) / 21600.0, 9) as rate from metrics group by 1, 2"""))
def spans_per_window(spark, sf_dir):
    out = M.windowed(T.metrics(spark, sf_dir), "6 hours", ["stage"])
    return out.withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6), "rate": F.round("rate", 9)})


@query("request_timings", metric("select user_id as request_id, max_by(value, (ts, event_id)) as value from metrics group by 1"))
def request_timings(spark, sf_dir):
    m = T.metrics(spark, sf_dir).withColumnRenamed("user_id", "request_id")
    return M.request_timings(m, m.select("request_id").distinct())
