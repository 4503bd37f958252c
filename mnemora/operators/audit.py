"""Integrity checks over the ingestion tables, and operational overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(memories: DataFrame, chunk_memories: DataFrame) -> DataFrame:
    """Memories that no chunk gave."""
    return memories.join(chunk_memories.select("memory_id"), "memory_id", "left_anti")


def orphans_by_day(memories: DataFrame, chunk_memories: DataFrame) -> DataFrame:
    return orphans(memories, chunk_memories).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("orphans"))


def orphan_impact(memories: DataFrame, chunk_memories: DataFrame, memory_entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: orphans, those still retrievable, their entity links and their edges."""
    lost = orphans(memories, chunk_memories)
    ids = lost.select("memory_id")
    parts = [
        lost.agg(F.count("*").alias("total"), F.count_if(F.col("forgotten_at").isNull()).alias("retrievable")),
        memory_entities.join(ids, "memory_id", "left_semi").agg(F.count("*").alias("entity_links")),
        edges.join(ids, "memory_id", "left_semi").agg(F.count("*").alias("edges")),
    ]
    one = [p.select(F.lit(1).alias("k_"), "*") for p in parts]  # three rows in all
    return one[0].join(one[1], "k_").join(one[2], "k_").drop("k_")


def completed_without_chunks(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    return sources.where(F.col("status") == "completed").join(chunks.select("source_id"), "source_id", "left_anti")


def sequence_gaps(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.max("sequence").alias("last"), F.count("*").alias("n")).where(F.col("last") + 1 != F.col("n"))


def checkpoint_ahead(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources whose checkpoint claims more chunks than there are."""
    n = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    mark = F.get_json_object("meta", "$.ingest_next_sequence").try_cast("int")
    return sources.withColumn("mark", mark).where("mark is not null").join(n, "source_id", "left").where(F.col("mark") > F.coalesce("n", F.lit(0))).select("source_id", "mark", F.coalesce("n", F.lit(0)).alias("n"))


def unfinished(sources: DataFrame) -> DataFrame:
    rows = sources.where(F.col("status").isin("pending", "processing"))
    return rows.groupBy("status").agg(F.count("*").alias("sources"), F.min(F.to_date("created_at")).alias("oldest"))


def tombstones(spaces: DataFrame) -> DataFrame:
    return spaces.where(F.col("deleted_at").isNotNull()).agg(F.count("*").alias("spaces"), F.min("deleted_at").alias("oldest"))


def ingestion_health(jobs: DataFrame) -> DataFrame:
    """Jobs by status with the oldest, and the mean seconds from start to end."""
    took = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"), F.min(F.to_date("created_at")).alias("oldest"), F.avg(took.cast("double")).alias("mean_seconds"))
