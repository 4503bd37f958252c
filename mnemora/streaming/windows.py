"""Fixed-window rate limits, in batch and as a stream: what is over the limit still counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_start(at: Column, seconds: int) -> Column:
    """The floor of the time to a multiple of the window, as epoch seconds."""
    return F.floor(F.unix_timestamp(at) / seconds) * seconds


def rate_windows(events: DataFrame, limits: dict[str, tuple[int, int]], key: str, at: str = "ts") -> DataFrame:
    """(key, scope, start, n, over) of several limits {scope: (seconds, limit)} in one pass over the events."""
    scopes = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), window_start(F.col(at), sec).alias("start"), F.lit(limit).alias("limit")) for s, (sec, limit) in limits.items()]))
    rows = events.select(key, scopes.alias("w")).select(key, "w.*")
    return rows.groupBy(key, "scope", "start").agg(F.count("*").alias("n"), F.max("limit").alias("limit")).withColumn("over", F.greatest(F.col("n") - F.col("limit"), F.lit(0)).cast("long")).drop("limit")


def admitted(events: DataFrame, seconds: int, limit: int, key: str, order: str, at: str = "ts") -> DataFrame:
    """Marks the events within the limit of their window."""
    w = W.partitionBy(key, window_start(F.col(at), seconds)).orderBy(at, order)
    return events.withColumn("admitted", F.row_number().over(w) <= limit)


def rate_stream(events: DataFrame, size: str, limit: int, key: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The streaming form: counts per tumbling window behind a watermark."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))
