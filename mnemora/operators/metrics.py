"""Aggregates over sampled metric rows: each row stands for `weight` events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.operators.numbering import running_within

MIN_SAMPLES = 100


def weighted_mean(keys: list[str], metrics: DataFrame, value: str = "value", weight: str = "weight") -> DataFrame:
    return metrics.groupBy(*keys).agg(F.sum(weight).alias("samples"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def weighted_quantiles(metrics: DataFrame, keys: list[str], ps=(0.5, 0.95, 0.99), value: str = "value", weight: str = "weight") -> DataFrame:
    """Exact weighted quantiles without interpolation: the first value whose running weight reaches p of all.

    Equal values are summed first; running weights are taken by partition, so no task holds a key's values.
    """
    sums = metrics.groupBy(*keys, value).agg(F.sum(weight).alias("w_"))
    running = running_within(sums, keys, [value], "w_", "run_", "all_")
    picks = [F.min(F.when(F.col("run_") >= p * F.col("all_"), F.col(value))).alias(f"p{round(100 * p)}") for p in ps]
    return running.groupBy(*keys).agg(F.max("all_").alias("samples"), *picks)


def weighted_share(metrics: DataFrame, keys: list[str], test: Column, name: str, weight: str = "weight") -> DataFrame:
    """Percent of the weight that passes a test; 0 where there is no weight."""
    hit = F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0))
    return metrics.groupBy(*keys).agg((100 * hit / F.greatest(F.sum(weight).cast("double"), F.lit(1e-9))).alias(name))


def weighted_counts(metrics: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    return metrics.groupBy(*keys).agg(F.sum(weight).alias("samples"))


def enough(value: Column, samples: Column, least: int = MIN_SAMPLES) -> Column:
    return F.when(samples >= least, value)


def cohort_delta(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], least: int = MIN_SAMPLES) -> DataFrame:
    """Percent change per key between two cohorts with `samples`; null where one has too few. Keys of one cohort stay."""
    from mnemora.functions.vectors import percent_delta

    b = before.select(*keys, F.col("samples").alias("before_samples"), *[F.col(c).alias(f"before_{c}") for c in columns])
    a = after.select(*keys, F.col("samples").alias("after_samples"), *[F.col(c).alias(f"after_{c}") for c in columns])
    both = b.join(a, keys, "full")
    ok = (F.coalesce("before_samples", F.lit(0)) >= least) & (F.coalesce("after_samples", F.lit(0)) >= least)
    deltas = [F.when(ok, percent_delta(F.col(f"before_{c}"), F.col(f"after_{c}"))).alias(f"{c}_delta") for c in columns]
    return both.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before_samples", "after_samples")], *deltas)


def nearest_rank(p: float, value: str) -> Column:
    """The value at place ceil(n * p)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def order_statistics(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, one column for each place): the values at places (from 1, of the number of values that aren't null) in
    order. Equal values are counted first and places found by two-phase running counts, so a key of any size is spread
    over tasks."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c_"))
    running = running_within(counts, keys, [value], "c_", "run_", "all_")
    here = lambda at: (F.col("run_") >= at) & (F.col("run_") - F.col("c_") < at)
    return running.groupBy(*keys).agg(*[F.max(F.when(here(place(F.col("all_"))), F.col(value))).alias(name) for name, place in places.items()])


def at_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.ceil(n * F.lit(p))


def with_statistics(out: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates with the statistics of the same keys, null ones too."""
    same = F.lit(True)
    for k in keys:
        same = same & out[k].eqNullSafe(found[k])
    return out.join(found, same, "left").select(*[out[c] for c in out.columns], *[found[c] for c in found.columns if c not in keys])


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return order_statistics(rows, keys, value, {"upper_median": lambda n: F.floor(n / 2) + 1})


def latency_summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    place = lambda n: F.lit(0.9) * (n - 1)
    found = order_statistics(rows, keys, value, {"p50": at_rank(0.5), "p95": at_rank(0.95), "low_": lambda n: F.floor(place(n)) + 1, "high_": lambda n: F.ceil(place(n)) + 1})
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("there_"))
    part = place(F.col("there_")) - F.floor(place(F.col("there_")))
    linear = F.col("low_") * (1 - part) + F.col("high_") * part
    return with_statistics(out, found, keys).select(*keys, "n", "min", "p50", "p95", "max", "mean", linear.alias("p90_linear"))


def windowed(spans: DataFrame, step: str, keys: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    """Counts, sums, means and quantiles per tumbling window and key."""
    rows = spans.select(F.window(at, step).alias("w"), *keys, value)
    out = rows.groupBy("w", *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    out = with_statistics(out, order_statistics(rows, ["w", *keys], value, {"p50": at_rank(0.5), "p95": at_rank(0.95)}), ["w", *keys])
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return out.withColumn("rate", F.col("n") / seconds).withColumn("start", F.unix_timestamp("w.start")).drop("w")


def retrieval_quality(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Per query: how well ranked results (query_id, rank, content) meet its facts (query_id, fact_id, stale, needle).

    Coverage of the gold facts, whether all are there, whether the first result is relevant, the
    reciprocal rank of the first gold fact, and whether a stale one comes before it.
    """
    low = F.lower("content")
    met = facts.join(results, "query_id", "left").withColumn("at", F.when(F.contains(low, F.lower("needle")), F.col("rank")))
    ranks = met.groupBy("query_id", "fact_id", "stale").agg(F.min("at").alias("at"))
    gold = lambda x: F.when(~F.col("stale"), x)
    first, stale = F.min(gold(F.col("at"))), F.min(F.when(F.col("stale"), F.col("at")))
    n, found = F.count(gold(F.col("fact_id"))), F.count(gold(F.col("at")))
    return ranks.groupBy("query_id").agg(
        F.when(n > 0, found / n).alias("coverage"),
        ((n > 0) & (found == n)).alias("all_facts"),
        F.coalesce(first == 1, F.lit(False)).alias("top1_relevant"),
        F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(stale < first, F.lit(False)).alias("stale_before_fresh"),
    )


def quality_means(quality: DataFrame, keys: list[str]) -> DataFrame:
    flag = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return quality.groupBy(*keys).agg(F.count("*").alias("queries"), F.avg("coverage").alias("coverage"), flag("all_facts"), flag("top1_relevant"), F.avg("reciprocal_rank").alias("mrr"), flag("stale_before_fresh"))


def request_timings(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each expected request the last logged timing."""
    rows = events.join(expected.select("request_id").distinct(), "request_id", "left_semi")
    return rows.groupBy("request_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def latencies_with_server(samples: DataFrame, timings: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: medians of what its requests (query_id, request_id, total) took the client and, by the logged
    (request_id, took), the server; requests without a timing; and the distinct sessions of its results (query_id, session_id).
    """
    per_query = samples.join(timings, "request_id", "left").groupBy("query_id").agg(
        F.count("*").alias("samples"), nearest_rank(0.5, "total").alias("total_median"), nearest_rank(0.5, "took").alias("took_median"), F.sum(F.col("took").isNull().cast("long")).alias("missing")
    )
    sessions = results.groupBy("query_id").agg(F.count("*").alias("results"), F.countDistinct("session_id").alias("sessions"))
    return per_query.join(sessions, "query_id", "left").na.fill(0, ["results", "sessions"])
