"""Incremental usage roll-up: each micro-batch is added once.

Deltas are kept by batch id, so a batch that runs again overwrites its own rows; the counters are the sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.analytics import COUNTERS, KEYS


def usage_delta(events: DataFrame) -> DataFrame:
    """Counters of a batch of usage events (org_id, user_id, space_id, ts, kind, amount)."""
    of = {"sources_ingested": "ingested", "sources_failed": "failed", "memories_created": "memory", "tokens_ingested": "tokens", "search_queries": "search"}
    return events.groupBy("org_id", "user_id", "space_id", F.to_date("ts").alias("date")).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == of[c], F.col("amount"))), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def start_rollup(events: DataFrame, deltas: str, checkpoint: str, **trigger):
    """Starts the stream; `deltas` is a folder with one part per batch."""

    def add(batch: DataFrame, number: int) -> None:
        usage_delta(batch).write.mode("overwrite").parquet(f"{deltas}/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_usage(spark: SparkSession, deltas: str) -> DataFrame:
    return spark.read.parquet(deltas).groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])
