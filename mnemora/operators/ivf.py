"""An inverted-file index of vectors: approximate nearest neighbours by probing few cells, verified exactly.

Coarse centroids are fitted on a bounded sample (SAMPLE rows, by the least hashes of their keys); every row is
assigned to its nearest one and the table is written in order of the cells, so a query reads its cells alone.
Within the probed cells scores are exact. Rows without a vector, or with a zero one, are in no cell and are
never found; nearest() and nearest_batch() remain the exact way. How many cells are probed is measured on the
sample: as many as hold RECALL of the neighbours of TRIALS of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.operators.knn import MIN_SCORE, POOL, _rows, _unit, asked_of, cell_rows, dealt, each_part, met_in_cells, nearest
from mnemora.sources.scratch import written

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 2048, 10
RECALL, TRIALS = 0.95, 512  # of the sample's own neighbours, for a recall of at least 0.9 over all rows


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame  # (cell, key, embedding)
    centroids: np.ndarray  # unit length
    sizes: DataFrame  # (cell, n): at most MOST_CELLS rows
    key: str
    probes: int


def fitted(vectors: DataFrame, key: str, cells: int | None = None, sample: int = SAMPLE, k: int = POOL) -> tuple[np.ndarray, int]:
    """Centroids by spherical k-means over the sample (about 2 * sqrt(rows) of them, one per 8 sample rows at most), and
    how many to probe for the `k` nearest rows."""
    order = F.xxhash64(key)
    rows = vectors.where(F.size("embedding") > 0).select(order.alias("h"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("h").limit(sample).collect()
    x = _unit(np.array([r.embedding for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))
    x = x[np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)]
    if not len(x):
        return np.zeros((0, 1)), 1
    total = vectors.count()
    n = cells or max(1, min(MOST_CELLS, int(2 * total**0.5), len(x) // 8))
    at = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        there = (sums != 0).any(axis=1)
        at[there] = _unit(sums[there])
    # the sample's neighbours of a row are as far away as its k nearest among all rows
    near = min(len(x), 1 + max(1, round(k * len(x) / max(total, 1))))
    picked = np.arange(0, len(x), max(1, len(x) // TRIALS))
    trial = x[picked]
    own = np.argmax(x @ at.T, axis=1)
    found = np.argpartition(-(trial @ x.T), near - 1, axis=1)[:, :near]
    place = np.argsort(np.argsort(-(trial @ at.T), axis=1, kind="stable"), axis=1)
    depth = np.take_along_axis(place, own[found], axis=1)
    others = found != picked[:, None]
    depth = np.sort(depth[others] if others.any() else depth.ravel())
    return at, int(depth[min(len(depth) - 1, int(RECALL * len(depth)))]) + 1


def build(vectors: DataFrame, key: str = "vec_id", cells: int | None = None, probes: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of all rows."""
    at, measured = fitted(vectors, key, cells, sample)
    shared = vectors.sparkSession.sparkContext.broadcast(at)  # at most MOST_CELLS vectors

    def assign(batches):
        for batch in batches:
            good, x = _rows(batch, "embedding")
            x = _unit(x)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) if len(x) else np.zeros(0, bool)
            if fine.any():
                own = np.argmax(x[fine] @ shared.value.T, axis=1)
                part = batch.take(pa.array(good[fine]))
                yield pa.record_batch([pa.array(own.astype(np.int32)), *part.columns], names=["cell", *part.schema.names])

    rows = vectors.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(assign, f"cell int, {key} long, embedding array<double>")
    stored = written(rows, "assigned")
    stored = written(stored.repartitionByRange("cell", key).sortWithinPartitions("cell", key), "vector-index")
    return VectorIndex(stored, at, stored.groupBy("cell").agg(F.count("*").alias("n")), key, probes or measured)


def nearest_probed(index: VectorIndex, query: list[float], k: int = POOL, min_score: float = MIN_SCORE) -> DataFrame:
    """As nearest(), among the cells whose centroids are closest to the query."""
    if not len(index.centroids) or not query:
        return nearest(index.rows, [], k, min_score, index.key)
    score = _unit(np.array([query], dtype=np.float64))[0] @ index.centroids.T
    cells = np.argsort(-score, kind="stable")[: index.probes].tolist()
    return nearest(index.rows.where(F.col("cell").isin(*cells)), query, k, min_score, index.key)


def nearest_probed_batch(index: VectorIndex, queries: DataFrame, k: int = POOL, min_score: float = MIN_SCORE, rows: int | None = None) -> DataFrame:
    """As nearest_batch(): neighbouring lists share a cell of about `rows` vectors, a longer list is split; a query goes
    once to each cell in which it probes a list, and keeps its best k there."""
    rows = rows or cell_rows(index.rows)
    spark = queries.sparkSession
    sizes = {r.cell: r.n for r in index.sizes.collect()}  # at most MOST_CELLS rows
    groups, parts, filled = np.zeros(len(index.centroids), dtype=np.int64), {}, 0
    for one in sorted(sizes):  # lists side by side until a cell is full
        groups[one] = len(parts) - 1 if parts and filled + sizes[one] <= rows else len(parts)
        filled = sizes[one] if groups[one] == len(parts) else filled + sizes[one]
        parts[int(groups[one])] = max(1, -(-filled // rows))
    shared, probes = spark.sparkContext.broadcast((index.centroids, groups)), index.probes

    def probe(batches):
        for batch in batches:
            good, x = _rows(batch, "embedding")
            at, group = shared.value
            if not len(good) or not len(at):
                continue
            lists = np.argsort(-(_unit(x) @ at.T), axis=1, kind="stable")[:, :probes]
            met, goes, probed = [], [], []
            for i, own in enumerate(lists):
                for g in np.unique(group[own]):
                    met.append(good[i])
                    goes.append(g)
                    probed.append(own[group[own] == g].tolist())
            part = batch.take(pa.array(np.array(met)))
            yield pa.record_batch([*part.columns, pa.array(np.array(goes, dtype=np.int32)), pa.array(probed, pa.list_(pa.int32()))], names=[*part.schema.names, "cell", "probed"])

    q = asked_of(queries, k, min_score).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("k").cast("int").alias("k"), F.col("min_score").cast("double").alias("min_score"))
    n = q.count()
    q = q.mapInArrow(probe, "query_id long, embedding array<double>, k int, min_score double, cell int, probed array<int>")
    table = spark.createDataFrame([(one, int(groups[one]), parts[int(groups[one])]) for one in sorted(sizes)], "list int, cell int, parts int")
    vectors = index.rows.withColumnRenamed("cell", "list").join(F.broadcast(table), "list")  # at most MOST_CELLS rows
    left = vectors.select("list", "cell", index.key, "embedding", F.pmod(F.xxhash64(index.key), F.col("parts")).cast("int").alias("part"), each_part(n, rows).alias("block"))
    split = F.broadcast(table.select("cell", "parts").distinct())
    right = q.join(split, "cell").select("*", dealt(n, rows, "query_id").alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return met_in_cells(left, right, ["cell", "part", "block"], index.key)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, wanted, hit): how many of each query's exact neighbours were found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hit"))
