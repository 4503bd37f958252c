"""State of jobs, sources and spaces over time: forgetting, retention, redrive, finalisation, guarded writes.

Spark tables are rewritten, not updated: each function gives the table after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.operators.listing import in_batches

RETENTION_DAYS = {"codes": 0, "tokens": 30, "jobs": 90, "billing_events": 180, "usage": 400}
TERMINAL = ["completed", "failed", "partial"]


def seconds_before(now: Column, at: str) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(F.col(at))


def forget(memories: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Marks memories, and the edges they gave, as forgotten; what is forgotten keeps its time."""
    marks = ids.select("memory_id", F.lit(True).alias("gone_")).distinct()

    def marked(df: DataFrame) -> DataFrame:
        return df.join(marks, "memory_id", "left").withColumn("forgotten_at", F.coalesce("forgotten_at", F.when(F.col("gone_"), now))).select(*df.columns)

    return marked(memories), marked(edges)


def kept(rows: DataFrame, at: str, now: Column, days: int, also: Column | None = None) -> DataFrame:
    """What a retention sweep leaves; `also` limits the sweep to some rows."""
    old = seconds_before(now, at) > days * 86_400
    return rows.where(~F.coalesce(old if also is None else old & also, F.lit(False)))


def retention_sweeps(tables: dict[str, DataFrame], now: Column, days: dict[str, int] = RETENTION_DAYS) -> dict[str, DataFrame]:
    """What the sweeps leave of codes (expires_at, used), tokens (expires_at, revoked_at), jobs (status, created_at),
    billing_events (processed_at, received_at) and usage (date). Jobs that run and events that wait stay at any age."""
    cut = {name: F.timestamp_seconds(F.unix_timestamp(now) - n * 86_400) for name, n in days.items()}
    gone = {
        "codes": (F.col("expires_at") < cut["codes"]) | F.col("used"),
        "tokens": (F.col("expires_at") < cut["tokens"]) & (F.col("revoked_at") < cut["tokens"]),
        "jobs": F.col("status").isin(TERMINAL) & (F.col("created_at") < cut["jobs"]),
        "billing_events": F.col("processed_at").isNotNull() & (F.col("received_at") < cut["billing_events"]),
        "usage": F.col("date") < F.to_date(cut["usage"]),
    }
    return {name: df.where(~F.coalesce(gone[name], F.lit(False))) if name in gone else df for name, df in tables.items()}


def active_jobs(jobs: DataFrame, now: Column, pending: int = 1200, processing: int = 1200) -> DataFrame:
    """Jobs that are waiting or running, within the seconds that either may take."""
    waits = (F.col("status") == "pending") & (seconds_before(now, "created_at") <= pending)
    runs = (F.col("status") == "processing") & (seconds_before(now, "started_at") <= processing)
    return jobs.where(waits | runs)


def stale_jobs(jobs: DataFrame, now: Column, stuck: int = 1200) -> DataFrame:
    """Jobs whose lease is long over; they count as failed."""
    return jobs.where((F.col("status") == "processing") & (seconds_before(now, "started_at") > stuck)).withColumn("status", F.lit("failed"))


def redrive_plan(sources: DataFrame, spaces: DataFrame, now: Column, stuck: int = 1200, debounce: int = 120, recent_days: int = 7, attempts: int = 5, size: int = 10) -> DataFrame:
    """(source_id, action, batch_no): which unfinished sources of active spaces are run again, in batches per owner.

    Those without owner or out of attempts are marked, not run.
    """
    age = seconds_before(now, "updated_at")
    due = (F.col("status").isin("pending", "processing") & (age > stuck)) | ((F.col("status") == "failed") & (age > debounce))
    rows = sources.where(due & (seconds_before(now, "created_at") <= recent_days * 86_400)).join(spaces.where("deleted_at is null").select("space_id"), "space_id", "left_semi")
    action = F.when(F.col("owner_user_id").isNull(), "ownerless").when(F.col("attempts") >= attempts, "exhausted").otherwise("redrive")
    rows = rows.withColumn("action", action)
    run = in_batches(rows.where("action = 'redrive'"), ["org_id", "space_id", "owner_user_id"], ["created_at", "source_id"], size)
    return run.unionByName(rows.where("action <> 'redrive'").withColumn("batch_no", F.lit(None).cast("long"))).select("source_id", "org_id", "space_id", "owner_user_id", "action", "batch_no")


def job_batches(sources: DataFrame, size: int = 10) -> DataFrame:
    """Sources of a request split into jobs of `size`."""
    return in_batches(sources, ["org_id", "space_id"], ["source_id"], size)


def finalizable_spaces(spaces: DataFrame, jobs: DataFrame, now: Column, grace_days: int = 30, most: int = 10) -> DataFrame:
    """Deleted spaces past their grace and without active job, oldest first."""
    old = spaces.where(F.col("deleted_at").isNotNull() & (seconds_before(now, "deleted_at") > grace_days * 86_400))
    busy = jobs.where(F.col("status").isin("pending", "processing")).select("space_id")
    return old.join(busy, "space_id", "left_anti").orderBy("deleted_at", "space_id").limit(most)


def propagated_visibility(memories: DataFrame, source_ids: DataFrame, chunks: DataFrame, chunk_memories: DataFrame, visibility: str) -> DataFrame:
    """Memories after their sources' visibility changed."""
    doomed = chunk_memories.join(chunks.join(source_ids, "source_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi").select("memory_id", F.lit(True).alias("hit_")).distinct()
    return memories.join(doomed, "memory_id", "left").withColumn("visibility", F.when(F.col("hit_"), visibility).otherwise(F.col("visibility"))).select(*memories.columns)


def expired_plans(subscriptions: DataFrame, now: Column, grace_days: int = 3) -> DataFrame:
    """Subscriptions after a billing sweep: unpaid ones past their grace and grants that ended fall back to the free plan."""
    unpaid = (F.col("status") == "past_due") & (seconds_before(now, "due_at") > grace_days * 86_400)
    over = F.col("grant_until").isNotNull() & (F.col("grant_until") < now)
    return subscriptions.withColumn("plan", F.when(F.coalesce(unpaid | over, F.lit(False)), "free").otherwise(F.col("plan")))


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of each key the row of the highest version; new rows win ties."""
    both = table.withColumn("new_", F.lit(0)).unionByName(rows.withColumn("new_", F.lit(1)))
    return both.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version), F.desc("new_")))).where("n_ = 1").select(*table.columns)


def guarded_insert(table: DataFrame, rows: DataFrame, owner: str, order: str, cap: int) -> DataFrame:
    """Adds rows while their owner has fewer than `cap`; the rest is refused, first come first served."""
    have = table.groupBy(owner).agg(F.count("*").alias("have_"))
    nth = rows.withColumn("n_", F.row_number().over(W.partitionBy(owner).orderBy(order))).join(have, owner, "left")
    fits = nth.where(F.coalesce("have_", F.lit(0)) + F.col("n_") <= cap).select(*rows.columns)
    return table.unionByName(fits)


def where_state(table: DataFrame, changes: DataFrame, key: str, expected: str, column: str = "status") -> DataFrame:
    """Applies (key, to) to the rows that are in the expected state; the others stay."""
    joined = table.join(changes.select(key, F.col("to").alias("to_")), key, "left")
    return joined.withColumn(column, F.when((F.col(column) == expected) & F.col("to_").isNotNull(), F.col("to_")).otherwise(F.col(column))).select(*table.columns)
