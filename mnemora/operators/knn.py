"""Exact nearest neighbours by cosine.

One query: an expression, and Spark's top-k (each task keeps k rows). Many queries: a grid of cells, each of a
bounded number of vectors and of queries. The vectors are scanned once and dealt to the cells as the queries
are; a cell's products are taken in its task, which keeps the best k per query. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.functions.vectors import cosine

POOL, MIN_SCORE = 50, 0.1
CELL_ROWS, CELL_BYTES = 32_768, 32 << 20
BLOCK_QUERIES, BLOCK_VECTORS, MOST_HELD = 512, 1024, 100_000  # of what a task compares and keeps at once


def nearest(vectors: DataFrame, query: list[float], k: int = POOL, min_score: float = MIN_SCORE, key: str = "vec_id") -> DataFrame:
    """(key, score, rank) of the k best with at least min_score; ties go to the smaller key."""
    if k <= 0 or not query:
        return vectors.select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(key, cosine(F.col("embedding"), q).alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)).cast("long"))


def _rows(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    good = np.flatnonzero(np.asarray(lists.is_valid()) & (np.asarray(lists.value_lengths().fill_null(0)) > 0))
    if not len(good):
        return good, np.zeros((0, 0))
    wide, held = pc.unique(lists.value_lengths().take(pa.array(good))), lists.take(pa.array(good)).flatten()
    if len(wide) > 1:
        raise ValueError("vectors of one cell differ in width")
    return good, held.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(good), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _best_of_cell(vectors: pa.Table, queries: pa.Table, key: str) -> pa.Table:
    """(query_id, key, score, k) of each query's best k vectors of a cell."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "k": pa.array([], pa.int32())})
    if not vectors.num_rows or not queries.num_rows:
        return empty
    asked, q = _rows(queries.combine_chunks().to_batches()[0], "embedding")
    own, x = _rows(vectors.combine_chunks().to_batches()[0], "embedding")
    if not len(asked) or not len(own):
        return empty
    ids, top, least = (queries.column(c).to_numpy()[asked] for c in ("query_id", "k", "min_score"))
    keys, x, unit = vectors.column(key).to_numpy()[own], _unit(x), _unit(q)

    def cut(held):
        q, v, s = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = place < top[q], place == top[q] - 1
        floor[q[last]] = s[last]
        return [q[keep], v[keep], s[keep]]

    # a few queries at a time meet a few vectors at a time: what is held doesn't depend on how many of either a cell has
    best, floor = [], least.astype(np.float64)  # floor: what a query's k-th best has so far; equals pass, their keys decide
    for a in range(0, len(asked), BLOCK_QUERIES):
        held, n = [], 0
        for rows, probing in _meetings(vectors, queries, own, asked[a : a + BLOCK_QUERIES]):
            few = probing + a
            for lo in range(0, len(rows), BLOCK_VECTORS):
                part = rows[lo : lo + BLOCK_VECTORS]
                score = unit[few] @ x[part].T
                q, v = np.nonzero(score >= floor[few][:, None])
                held.append([few[q], keys[part[v]], score[q, v]])
                n += len(q)
                if n > MOST_HELD:
                    held, n = [cut(held)], 0
        if held:
            q, v, s = cut(held)
            best.append(pa.table({"query_id": pa.array(ids[q], pa.int64()), key: pa.array(v, pa.int64()), "score": pa.array(s, pa.float64()), "k": pa.array(top[q], pa.int32())}))
    return pa.concat_tables(best) if best else empty


def _meetings(vectors: pa.Table, queries: pa.Table, own: np.ndarray, asked: np.ndarray):
    """(vectors, queries) that meet: all of them, or, where queries name `probed` ones of the vectors' lists, list by list."""
    if "probed" not in queries.column_names:
        yield np.arange(len(own)), np.arange(len(asked))
        return
    of_vector = vectors.column("list").to_numpy()[own]
    probed = queries.column("probed").combine_chunks()
    probed = [np.asarray(probed[int(i)].values) for i in asked]
    of_probe = np.repeat(np.arange(len(asked)), [len(p) for p in probed])
    flat = np.concatenate(probed)
    order, by_list = np.argsort(of_vector, kind="stable"), np.argsort(flat, kind="stable")
    lists, lo = np.unique(of_vector[order], return_index=True)
    ends = [np.searchsorted(flat[by_list], lists, side) for side in ("left", "right")]
    for lo, hi, a, b in zip(lo, [*lo[1:], len(order)], *ends, strict=True):
        if a < b:
            yield order[lo:hi], of_probe[by_list[a:b]]


def met_in_cells(vectors: DataFrame, queries: DataFrame, cell: list[str], key: str) -> DataFrame:
    """(query_id, key, score, rank) of the best k over all cells: both sides' rows carry the columns of their cell."""
    extra = [c for c in ("list",) if c in vectors.columns], [c for c in ("probed",) if c in queries.columns]
    left = vectors.select(*cell, *extra[0], F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).groupBy(*cell)
    right = queries.select(*cell, *extra[1], F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("k").cast("int").alias("k"), F.col("min_score").cast("double").alias("min_score")).groupBy(*cell)
    found = left.cogroup(right).applyInArrow(lambda v, q: _best_of_cell(v, q, key), f"query_id long, {key} long, score double, k int")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key)).cast("long"))
    return ranked.where(F.col("rank") <= F.col("k")).drop("k")


def asked_of(queries: DataFrame, k: int, min_score: float) -> DataFrame:
    """Queries with a vector and a k of their own or the given one."""
    for name, value in (("k", k), ("min_score", min_score)):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(value))
    return queries.where((F.col("k") > 0) & (F.size("embedding") > 0)).select("query_id", "embedding", "k", "min_score")


def cell_rows(vectors: DataFrame) -> int:
    """How many vectors of this width make a cell's share of memory."""
    wide = vectors.where(F.size("embedding") > 0).select(F.size("embedding")).first()
    return max(256, min(CELL_ROWS, CELL_BYTES // (8 * wide[0]))) if wide else CELL_ROWS


def dealt(n: int | Column, size: int, *by: str) -> Column:
    """Which of n / size parts a row falls to."""
    parts = F.greatest(F.ceil(F.lit(n) / size), F.lit(1)) if isinstance(n, int) else F.greatest(F.ceil(n / size), F.lit(1))
    return F.pmod(F.xxhash64(*by), parts).cast("int")


def each_part(n: int | Column, size: int) -> Column:
    """All of the parts, one row each."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.explode(F.sequence(F.lit(0), (F.greatest(F.ceil(n / size), F.lit(1)) - 1).cast("int")))


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = POOL, min_score: float = MIN_SCORE, key: str = "vec_id", rows: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) for a table of (query_id, embedding); its columns k and min_score, where
    there are any, hold for each query. Queries without vector and those of k <= 0 find nothing. A cell has about `rows`
    vectors and as many queries."""
    q = asked_of(queries, k, min_score)
    rows = rows or cell_rows(vectors)
    n, asked = vectors.count(), q.count()
    left = vectors.select(key, "embedding", dealt(n, rows, key, "embedding").alias("part")).select("*", each_part(asked, rows).alias("block"))
    right = q.select("*", dealt(asked, rows, "query_id").alias("block")).select("*", each_part(n, rows).alias("part"))
    return met_in_cells(left, right, ["part", "block"], key)


def nearest_managed(vectors: DataFrame, query: list[float], k: int = POOL, most: int = 100, **rest) -> DataFrame:
    """As from a managed index, which returns `most` matches at most."""
    return nearest(vectors, query, min(k, most), **rest)


def vectors_of(vectors: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return vectors.join(ids.select(key).distinct(), key, "left_semi")


def upserted(vectors: DataFrame, rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """The store after the rows were put in: they take the place of those of the same key."""
    return vectors.join(rows.select(key), key, "left_anti").unionByName(rows)


def deleted(vectors: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return vectors.join(ids.select(key), key, "left_anti")
