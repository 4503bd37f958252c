"""Operator 5: near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine c lie 2 - 2c apart (squared). A fixed rotation spreads that over the axes;
the rotated vector is cut into BLOCKS blocks and each block gets the part of the squared-distance
budget that its dimensions have of all. Near vectors then keep the budget in one block at least, so
the union of the blocks' range joins holds all of them. A block's range join puts vectors into cells
of its first two axes (of its one axis where it has no second), with copies to the neighbouring cells that the
radius reaches; cells of very many vectors are dealt as pairs of chunks. Within a task a third axis is
sorted, and a vector meets only those within the radius on it. Candidates are verified by their cosine in double precision; a
pair counts in the first block that holds it, so its links are counted once. A task returns a count
and one tree link per vector, never the pairs.

Equal vectors of a label are one class with a weight. Vectors that are null, zero or hold null or
non-finite components, and those without label, link with nothing; vectors of other lengths are never
compared; rows of one vec_id count as vectors of their own, repeated rows as copies; a null vec_id is left out
of the minima (a component of none but null ids has a null component_id, and its rows are kept); other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Work, components, groups, hot_keys, looked_up, on_batches

COSINE = 0.98
BLOCKS = 8
CHUNK, CHUNK_VALUES = 2048, 1 << 20  # vectors of a chunk: as many as hold so many numbers, up to 8 * CHUNK
MET, VERIFIED = 1 << 21, 1 << 22  # pairs of a strip, and numbers of the pairs verified at once
SLACK = 1e-9


@cache
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


@cache
def block_edges(dims: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)


def budgets(dims: int, cosine: float) -> np.ndarray:
    return (2 - 2 * cosine) * np.diff(block_edges(dims)) / dims + SLACK


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, cid, dims, raw): cid names the class of equal vectors; null where a row links with nothing."""

    def kernel(batch):
        column = batch.column(2)
        keys, raws, dims = [], [], []
        for k in range(batch.num_rows):
            x = column[k].values if column[k].is_valid and batch.column(1)[k].is_valid else None
            v = None if x is None or x.null_count else np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.float64) + 0.0
            if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                keys.append(None), raws.append(None), dims.append(None)
                continue
            raw = v.tobytes()
            label = str(batch.column(1)[k].as_py()).encode()
            keys.append(int.from_bytes(hashlib.blake2b(label + b":" + raw, digest_size=8).digest(), "little", signed=True))
            raws.append(raw if (v != v.astype(np.float32)).any() else v.astype(np.float32).tobytes())
            dims.append(len(v))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, type=pa.int64()), pa.array(dims, type=pa.int32()), pa.array(raws, type=pa.binary())], names=["vec_id", "label", "cid", "dims", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return on_batches(rows, ["vec_id", "label", "embedding"], kernel, "vec_id long, label string, cid long, dims int, raw binary")


def matrix(raws: list[bytes], dims: int) -> np.ndarray:
    if all(len(r) == 4 * dims for r in raws):
        return np.frombuffer(b"".join(raws), dtype=np.float32).reshape(-1, dims).astype(np.float64)
    return np.stack([np.frombuffer(r, dtype=np.float32 if len(r) == 4 * dims else np.float64).astype(np.float64) for r in raws])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cell_rows(classes: DataFrame, cosine: float) -> DataFrame:
    """(label, dims, block, x, y, home, cid, weight, raw) of every vector, block and cell it belongs to."""
    names = ["label", "dims", "block", "x", "y", "home", "cid", "weight", "raw"]

    def kernel(batch):
        all_dims = batch.column(1).to_numpy()
        for d in np.unique(all_dims):
            part = batch.filter(pa.array(all_dims == d))
            for lo in range(0, part.num_rows, 2000):
                rows = part.slice(lo, 2000)
                turned = unit(matrix(rows.column(4).to_pylist(), d)) @ rotation(int(d))
                edges = block_edges(int(d))
                for b, (edge, end, budget) in enumerate(zip(edges[:-1], edges[1:], budgets(int(d), cosine), strict=True)):
                    radius = float(np.sqrt(budget))
                    side = 2 * radius
                    at = turned[:, edge : min(edge + 2, end)] / side
                    if at.shape[1] < 2:
                        at = np.concatenate([at, np.zeros_like(at)], axis=1)
                    cell = np.floor(at).astype(np.int64)
                    inside = at - cell
                    reach = 0.5 + 1e-6
                    left, right, top = inside[:, 0] <= reach, inside[:, 0] >= 1 - reach, inside[:, 1] >= 1 - reach
                    for dx, dy, mask in ((0, 0, np.ones(len(at), bool)), (1, 0, right), (-1, 1, left & top), (0, 1, top), (1, 1, right & top)):
                        k = pa.array(np.flatnonzero(mask))
                        n = len(k)
                        if n:
                            c = cell[mask]
                            yield pa.record_batch(
                                [rows.column(0).take(k), rows.column(1).take(k), pa.array(np.full(n, b, np.int32)), pa.array(c[:, 0] + dx), pa.array(c[:, 1] + dy), pa.array(np.full(n, dx == dy == 0)), rows.column(2).take(k), rows.column(3).take(k), rows.column(4).take(k)],
                                names=names,
                            )

    return on_batches(classes, ["label", "dims", "cid", "weight", "raw"], kernel, "label string, dims int, block int, x long, y long, home boolean, cid long, weight long, raw binary")


def compare(block: int, dims: int, raws, home, part, i: int, j: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that link and have this block as their first, a bounded number at a time."""
    plain = matrix(raws, dims)
    norm = unit(plain)
    turned = norm @ rotation(dims)
    edges, budget = block_edges(dims), budgets(dims, cosine)
    cut = slice(edges[block], edges[block + 1])
    xs = turned[:, cut]
    sq = np.einsum("ij,ij->i", xs, xs)
    # in order of the block's last axis only a strip of the others is within the radius
    axis, radius = xs[:, -1], np.sqrt(budget[block]) + SLACK
    order = np.argsort(axis, kind="stable")
    left = order[part[order] == i]
    right = left if i == j else order[part[order] == j]
    step, few = max(1, min(256, MET // max(1, len(right)))), max(1, VERIFIED // dims)
    for lo in range(0, len(left), step):
        rows = left[lo : lo + step]
        strip = right[np.searchsorted(axis[right], axis[rows[0]] - radius) : np.searchsorted(axis[right], axis[rows[-1]] + radius, side="right")]
        near = sq[rows][:, None] + sq[strip][None, :] - 2 * (xs[rows] @ xs[strip].T) <= budget[block] + SLACK
        near &= home[rows][:, None] | home[strip][None, :]
        if i == j:
            near &= rows[:, None] < strip[None, :]
        u, v = np.nonzero(near)
        for at in range(0, len(u), few):
            a, b = rows[u[at : at + few]], strip[v[at : at + few]]
            gap = (turned[a] - turned[b]) ** 2
            inside = np.add.reduceat(gap, edges[:-1], axis=1) <= budget
            ok = inside[:, block] & ~inside[:, :block].any(axis=1)
            ok[ok] = np.einsum("ij,ij->i", norm[a[ok]], norm[b[ok]]) >= cosine
            if ok.any():
                yield a[ok], b[ok]


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs, for every index."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, u, old[v])
        np.minimum.at(label, v, old[u])
        label = np.minimum(label, label[label])
        if (label == old).all():
            return label


def links(classes: DataFrame, work: Work, cosine: float, chunk: int | None) -> DataFrame:
    """(cid, links, root): weighted links found in a task, and a tree link to a vector of the same component."""
    cells = cell_rows(classes, cosine)
    key = ["label", "dims", "block", "x", "y"]
    # a vector is sent once for each chunk of its cell; few cells have more than one chunk: fewer than the vectors' cells divided by it
    chunk = F.lit(chunk) if chunk else F.greatest(F.lit(CHUNK), F.least(F.lit(8 * CHUNK), F.floor(CHUNK_VALUES / F.col("dims"))))
    large = cells.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > chunk).withColumn("k", F.ceil(F.col("size") / chunk).cast("int"))
    parts = cells.join(F.broadcast(large.drop("size")), key, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    dealt = parts.select(*key, "home", "cid", "weight", "raw", "part", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
    names = [*key, "i", "j"]

    def solve(rows):
        _, dims, block, _, _, i, j = (rows.column(k)[0].as_py() for k in range(7))
        cid, weight, home, part = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("cid", "weight", "home", "part"))
        count, root = np.zeros(len(cid)), np.arange(len(cid))
        for u, v in compare(block, dims, rows.column("raw").to_pylist(), home, part, i, j, cosine):
            count += np.bincount(u, weights=weight[v], minlength=len(cid)) + np.bincount(v, weights=weight[u], minlength=len(cid))
            root = roots(len(cid), root[u], root[v])[root]
        if not count.any():
            return None
        at = np.flatnonzero(count > 0)
        return pa.record_batch([pa.array(cid[at]), pa.array(count[at].astype(np.int64)), pa.array(cid[root[at]])], names=["cid", "links", "root"])

    def run(batches):
        for rows in groups(batches, 7):
            if rows.num_rows > 1 and (out := solve(rows)):
                yield out

    dealt = dealt.select(*names, "cid", "weight", "raw", "home", "part")
    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "cid long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, chunk: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    with Work(vectors.sparkSession, "vector-dedup") as work:
        rows = work.save(vector_classes(vectors), "vectors")
        classes = work.save(rows.where("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("raw").alias("raw"), F.count("*").alias("weight"), F.min("vec_id").alias("smallest")), "classes")
        found = work.save(links(classes, work, cosine, chunk), "links")
        count = found.groupBy("cid").agg(F.sum("links").alias("links"))
        label = components(found, work, "cid", "root").withColumnRenamed("node", "cid")
        named = work.save(classes.select("cid", "weight", "smallest").join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "named")
        least = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
        member = looked_up(named, least, "component", hot_keys(named, "component", named.count()))
        per_class = member.join(count, "cid", "left").select("cid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
        some = rows.select("vec_id", "cid").where("cid is not null")
        joined = looked_up(some, per_class, "cid", hot_keys(some, "cid", some.count())).select("vec_id", "n_links", "component_id")
        alone = rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = joined.unionByName(alone)
        return work.keep(out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))
