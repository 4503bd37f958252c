"""Usage analytics: windows of days, totals, gap-filled series, break-downs, quotas, roll-ups and back-fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["sources_ingested", "sources_failed", "memories_created", "tokens_ingested", "search_queries"]
KEYS = ["org_id", "user_id", "space_id", "date"]


def total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)


def scoped_usage(daily: DataFrame, org: int, space: int | None = None) -> DataFrame:
    out = daily.where(F.col("org_id") == org)
    return out if space is None else out.where(F.col("space_id") == space)


def period_totals(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Sums of the counters over a closed range of days; zeros where there are no rows."""
    return daily.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(*map(total, COUNTERS))


def two_periods(daily: DataFrame, now_window: tuple[str, str], before: tuple[str, str]) -> DataFrame:
    """Both windows in one pass: the counters, and those of the window before as previous_*."""
    inside = lambda w: F.col("date").between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))
    rows = daily.where(inside((before[0], now_window[1])))
    sums = [F.coalesce(F.sum(F.when(inside(w), F.col(c))), F.lit(0)).cast("long").alias(p + c) for p, w in (("", now_window), ("previous_", before)) for c in COUNTERS]
    return rows.agg(*sums)


def daily_series(daily: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day of the range, zeros where nothing happened."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    sums = daily.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("date").agg(*map(total, COUNTERS))
    return days.join(sums, "date", "left").select("date", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def by_key(rows: DataFrame, key: str, count: str = "count") -> DataFrame:
    return rows.groupBy(key).agg(F.sum(count).cast("long").alias(count))


def by_space(daily: DataFrame, spaces: DataFrame) -> DataFrame:
    """Totals per space that still exists; usage outlives its space, so sums come first and the join is on few rows."""
    sums = daily.groupBy("space_id").agg(*map(total, COUNTERS))
    return sums.join(spaces.where(F.col("deleted_at").isNull()).select("space_id", "name"), "space_id", "left").where(F.col("name").isNotNull())


def month_to_date(daily: DataFrame, now: Column, column: str) -> DataFrame:
    return daily.where((F.col("date") >= F.trunc(now, "month")) & (F.col("date") <= F.to_date(now))).agg(total(column))


def quota(used: Column, limit: Column) -> Column:
    """(used, limit, remaining); -1 stands for no limit."""
    return F.struct(used.alias("used"), limit.alias("limit"), F.when(limit == -1, -1).otherwise(F.greatest(limit - used, F.lit(0))).cast("long").alias("remaining"))


def exceeded(used: Column, increment: Column, limit: Column) -> Column:
    return (limit != -1) & (used + increment > limit)


def quota_status(daily: DataFrame, limits: DataFrame, column: str, now: Column, increment: int = 0) -> DataFrame:
    """Per org: month-to-date use of a counter against its limit."""
    month = daily.where((F.col("date") >= F.trunc(now, "month")) & (F.col("date") <= F.to_date(now))).groupBy("org_id").agg(F.sum(column).alias("sum_"))
    used = F.coalesce("sum_", F.lit(0)).cast("long")
    return limits.join(month, "org_id", "left").select("org_id", quota(used, F.col("limit")).alias("q"), exceeded(used, F.lit(increment), F.col("limit")).alias("exceeded")).select("org_id", "q.*", "exceeded")


def active_counts(daily: DataFrame, windows: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Exact distinct counts of several keys in several windows, one row."""
    inside = lambda w: F.col("date").between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))
    flags = {name: inside(w) for name, w in windows.items()}
    parts = []
    for k in keys:  # a distinct per key first: what meets is one row per value and task
        seen = daily.groupBy(k).agg(*[F.max(f).alias(n) for n, f in flags.items()])
        parts.append(seen.agg(*[F.count_if(F.col(n)).alias(f"{k}_{n}") for n in flags]).select(F.to_json(F.struct("*")).alias("j")))
    fields = [f"{k}_{n}" for k in keys for n in flags]
    merged = reduce(DataFrame.unionByName, parts).select(F.explode(F.from_json("j", "map<string,long>")))
    return merged.groupBy().pivot("key", fields).agg(F.max("value"))


def new_rows(tables: dict[str, tuple[DataFrame, str]], windows: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(table, total, and per window the rows that came in it): instants from start to before end."""
    parts = []
    for name, (df, at) in tables.items():
        counts = [F.count_if((F.col(at) >= lo) & (F.col(at) < hi)).alias(w) for w, (lo, hi) in windows.items()]
        parts.append(df.agg(F.count("*").alias("total"), *counts).select(F.lit(name).alias("table"), "total", *windows))
    return reduce(DataFrame.unionByName, parts)


def backfill(sources: DataFrame, memories: DataFrame, before: Column) -> DataFrame:
    """Daily counters recomputed from sources and memories: a full join on the four keys; a null key meets nothing."""
    s = sources.groupBy(*KEYS).agg(F.count_if(F.col("status") == "completed").alias("sources_ingested"), F.count_if(F.col("status") == "failed").alias("sources_failed"))
    m = memories.groupBy(*KEYS).agg(F.count("*").alias("memories_created"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sources_ingested", "sources_failed", "memories_created")]
    return s.join(m, KEYS, "full").where(F.col("date") < before).select(*KEYS, *zero)


def rollup(daily: DataFrame, delta: DataFrame) -> DataFrame:
    """The counters after a batch: old and new rows, summed by key. Apply each batch once (see streaming.rollup)."""
    columns = [*KEYS, *COUNTERS]
    return daily.select(*columns).unionByName(delta.select(*columns)).groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])


def source_delta(sources: DataFrame, chunks: DataFrame, chunk_memories: DataFrame) -> DataFrame:
    """What a batch of finished sources adds: outcomes, tokens of completed ones, distinct memories."""
    made = chunks.join(chunk_memories, "chunk_id").groupBy("source_id").agg(F.count_distinct("memory_id").alias("made"))
    done = F.col("status") == "completed"
    rows = sources.join(made, "source_id", "left")
    return rows.groupBy(*KEYS).agg(
        F.count_if(done).alias("sources_ingested"),
        F.count_if(F.col("status") == "failed").alias("sources_failed"),
        F.coalesce(F.sum("made"), F.lit(0)).alias("memories_created"),
        F.coalesce(F.sum(F.when(done, F.col("token_count"))), F.lit(0)).alias("tokens_ingested"),
        F.lit(0).cast("long").alias("search_queries"),
    )


def job_status(items: DataFrame, key: str = "job_id") -> DataFrame:
    """completed where nothing failed, failed where all did, else partial."""
    failed, n = F.count_if(F.col("status") == "failed"), F.count("*")
    return items.groupBy(key).agg(F.when(failed == 0, "completed").when(failed == n, "failed").otherwise("partial").alias("status"), n.alias("sources"), failed.alias("failed"))
