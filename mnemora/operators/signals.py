"""The ranked signals that retrieval fuses: semantic, keyword, temporal. Each gives (memory_id, rank, score)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.functions.text import bounded_terms
from mnemora.functions.times import proximity
from mnemora.operators.keyword import KEYWORD_POOL, MIN_KEYWORD, build_index, keyword_matches, parse_query, query_terms, terms_table, top_matches
from mnemora.operators.knn import MIN_SCORE, POOL, nearest
from mnemora.operators.scope import TenantScope, active, scoped

TEMPORAL_LIMIT = 50
__all__ = ["keyword_signal", "keyword_signal_each", "match_terms", "memory_time", "parse_query", "ranked", "semantic_signal", "temporal_signal", "temporal_signal_each"]


def ranked(df: DataFrame, *order) -> DataFrame:
    """Ranks a set that a limit has bounded: the single partition holds at most that many rows."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def semantic_signal(memories: DataFrame, vectors: DataFrame, query: list[float], scope: TenantScope, limit: int = POOL, min_score: float = MIN_SCORE) -> DataFrame:
    """The nearest memories; those that the scope doesn't see are dropped, the ranks close up."""
    found = nearest(vectors, query, limit, min_score).select(F.col("vec_id").alias("memory_id"), "score")
    seen = active(scoped(memories, scope)).select("memory_id")
    return ranked(found.join(seen, "memory_id"), F.desc("score"), "memory_id").select("memory_id", "rank", "score")


def keyword_signal(memories: DataFrame, query: str, scope: TenantScope, limit: int = POOL, pool: int = KEYWORD_POOL, least: float = MIN_KEYWORD, index: DataFrame | None = None) -> DataFrame:
    """Lexical match and rank of one query: all words and phrases must occur (or one of the alternatives), none of the
    banned ones; see keyword.cover_density() for the rank. `index` is that of these memories, if there is one."""
    terms = query_terms(query)
    if not any(t[0] >= 0 for t in terms):
        return memories.select("memory_id", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("score")).limit(0)
    index = build_index(memories) if index is None else index
    rows = memories.sparkSession.createDataFrame([(0, *t) for t in terms], "query_id long, item int, choice int, offset int, stem string")
    wanted = index.where(F.col("stem").isin(*sorted({t[3] for t in terms})))  # reaches the scan
    seen = active(scoped(memories, scope)).select("memory_id")
    return top_matches(keyword_matches(wanted, F.broadcast(rows), seen), limit, pool, least).drop("query_id")


def match_terms(names: DataFrame, query: str, column: str = "name") -> DataFrame:
    """Names that share a word with the query (words as they are, joined by or)."""
    wanted = bounded_terms(F.lower(F.lit(query)))
    words = F.split(F.regexp_replace(F.lower(column), r"[^\w]+", " "), " ")
    return names.where(F.arrays_overlap(words, wanted))


def memory_time():
    return F.coalesce("event_time", "recorded_at", "created_at")


def temporal_signal(memories: DataFrame, scope: TenantScope, start: datetime, end: datetime, limit: int = TEMPORAL_LIMIT) -> DataFrame:
    """Memories of a time window, nearest to its centre first."""
    lo, hi = F.lit(start), F.lit(end)
    rows = active(scoped(memories, scope)).select("memory_id", memory_time().alias("at")).where(F.col("at").between(lo, hi))
    centre = (F.unix_micros(lo) + F.unix_micros(hi)) / 2
    rows = rows.withColumn("distance", F.abs(F.unix_micros("at") - centre))
    top = rows.orderBy("distance", F.desc("memory_id")).limit(min(limit, TEMPORAL_LIMIT))
    return ranked(top, "distance", F.desc("memory_id")).select("memory_id", "rank", proximity(F.col("at"), lo, hi).alias("score"))


# --- many requests at once ----------------------------------------------------------------------


def keyword_signal_each(memories: DataFrame, requests: DataFrame, scope: TenantScope, index: DataFrame | None = None, limit: int = POOL) -> DataFrame:
    """(query_id, memory_id, rank, score): keyword_signal() of each (query_id, query); equal texts are asked once."""
    texts = requests.groupBy("query").agg(F.min("query_id").alias("query_id"))
    seen = active(scoped(memories, scope)).select("memory_id")
    found = top_matches(keyword_matches(build_index(memories) if index is None else index, terms_table(texts), seen), limit)
    of_text = texts.withColumnRenamed("query_id", "asked_")
    return requests.select("query_id", "query").join(of_text, "query").join(found.withColumnRenamed("query_id", "asked_"), "asked_").select("query_id", "memory_id", "rank", "score")


def temporal_signal_each(memories: DataFrame, requests: DataFrame, scope: TenantScope, limit: int = TEMPORAL_LIMIT) -> DataFrame:
    """(query_id, memory_id, rank, score): temporal_signal() of each (query_id, start, end); null windows find nothing.

    Equal windows are searched once. Of memories of one moment only the `limit` first can be found. The memories are
    counted by day; a window meets only the days around its centre that, by these counts, can hold its best. Days lie
    in rings by their distance to the centre's day; ring d is out of reach once rings up to d - 3 hold enough.
    """
    limit, day = min(limit, TEMPORAL_LIMIT), lambda t: F.floor(F.unix_micros(t) / 86_400_000_000)
    rows = active(scoped(memories, scope)).select("memory_id", memory_time().alias("at")).where("at is not null")
    rows = rows.withColumn("n_", F.row_number().over(W.partitionBy("at").orderBy(F.desc("memory_id")))).where(F.col("n_") <= limit).drop("n_").withColumn("day", day("at"))
    windows = requests.where("start <= end").select("start", "end").distinct().withColumn("centre", (F.unix_micros("start") + F.unix_micros("end")) / 2)
    days = windows.select("*", F.explode(F.sequence(day("start"), day("end"))).alias("day")).join(rows.groupBy("day").agg(F.count("*").alias("n")), "day")
    whole = F.when((F.col("day") > day("start")) & (F.col("day") < day("end")), F.col("n")).otherwise(0)
    days = days.withColumn("ring", F.abs(F.col("day") - F.floor(F.col("centre") / 86_400_000_000)))
    inner = F.sum(whole).over(W.partitionBy("start", "end").orderBy("ring").rangeBetween(W.unboundedPreceding, -3))
    near = days.withColumn("inner", F.coalesce(inner, F.lit(0))).where(F.col("inner") < limit).select("start", "end", "centre", "day")
    met = near.join(rows, "day").where(F.col("at").between(F.col("start"), F.col("end"))).withColumn("distance", F.abs(F.unix_micros("at") - F.col("centre")))
    top = met.withColumn("rank", F.row_number().over(W.partitionBy("start", "end").orderBy("distance", F.desc("memory_id"))).cast("long")).where(F.col("rank") <= limit)
    top = top.select("start", "end", "memory_id", "rank", proximity(F.col("at"), F.col("start"), F.col("end")).alias("score"))
    return requests.select("query_id", "start", "end").join(top, ["start", "end"]).select("query_id", "memory_id", "rank", "score")
