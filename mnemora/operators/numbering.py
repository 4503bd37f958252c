"""Places of rows within their keys, for keys of any size: two phases, no key's rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.sources.scratch import written

BLOCK_BITS = 33  # monotonically_increasing_id has the partition above these bits


def numbered_within(df: DataFrame, key: list[str], order: list[str | Column], index: str = "index", size: str = "size", save: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """The rows with their place (from 0) among those of their key, in the given order, and the key's number of rows.

    The rows are range-partitioned by key and order and written with the place in their partition. Each partition's
    count per key then gives an offset, which is added. `order` should tell all different rows apart: rows that it
    doesn't are numbered as they come. Nulls are a key like any other, and come first.
    """
    at, block, first, before = (_free(df, x) for x in ("at", "block", "first", "before"))
    placed = _placed(df, key, order, at, block, save)
    met = _with_offsets(placed, key, block, F.count("*"), before, size, {first: F.min(at)})
    return met.select(*df.columns, (F.col(before) + F.col(at) - F.col(first)).alias(index), F.col(size).cast("long").alias(size))


def running_within(df: DataFrame, key: list[str], order: list[str | Column], weight: str, run: str = "run", total: str = "total", save: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """The rows with the running sum of a weight within their key, themselves included, and the key's whole sum; by
    partition first, as in numbered_within()."""
    at, block, before = (_free(df, x) for x in ("at", "block", "before"))
    placed = _placed(df, key, order, at, block, save)
    own = F.sum(weight).over(W.partitionBy(*key, block).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow))
    met = _with_offsets(placed.withColumn(run, own), key, block, F.sum(weight), before, total, {})
    return met.select(*df.columns, (F.col(before) + F.col(run)).alias(run), total)


def _placed(df: DataFrame, key: list[str], order: list[str | Column], at: str, block: str, save: Callable) -> DataFrame:
    """The rows in order, with their partition and a number that rises in it."""
    rows = save(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    return rows.withColumn(block, F.shiftright(at, BLOCK_BITS))


def _with_offsets(rows: DataFrame, key: list[str], block: str, measure: Column, before: str, total: str, more: dict[str, Column]) -> DataFrame:
    """The rows with what the key's earlier partitions and all of them have: one row a key and partition."""
    names = {k: f"{before}_{k}" for k in [*key, block]}
    parts = rows.groupBy(*key, block).agg(measure.alias(before), *[c.alias(n) for n, c in more.items()])
    own = W.partitionBy(*key)
    sums = (F.sum(before).over(own.orderBy(block)) - F.col(before)).alias(before), F.sum(before).over(own).alias(total)
    parts = parts.select(*[F.col(k).alias(n) for k, n in names.items()], *more, *sums)
    same = F.col(block) == F.col(names[block])
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    return rows.join(parts, same)


def _free(df: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken or any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name
