"""Helpers shared by the corpus operators: table access, shared storage, batch-wise text kernels.

The kernels work on one Arrow batch (or a slice of it) at a time: the UTF-8 bytes of all its
texts in one numpy array plus the documents' offsets, so no per-row Python runs in the hot path.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver can reach. Only a local session may have one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='mnemora-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a written table: a lost executor costs a reread, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Work:
    """The written tables of one operator's run; on leaving, all are deleted but those that were kept.

    A table may be dropped earlier, once nothing reads it again: rounds don't pile up on the disk.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in list(self.tables.values())])

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = out, path
        return out

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """A table that what the operator returns reads."""
        out = df if id(df) in self.tables else self.save(df, name)
        self.tables.pop(id(out))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if df is not None and (found := self.tables.pop(id(df), None)):
                removed(self.spark, found[1])


def crc_bucket(doc_id, modulus: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# --- batches -----------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text gets a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def per_slice(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def on_batches(df: DataFrame, columns: list[str], kernel: Callable, schema: str) -> DataFrame:
    """mapInArrow over the named columns; the kernel turns a batch into batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from kernel(batch)

    return df.select(*columns).mapInArrow(run, schema)


# --- hashing -----------------------------------------------------------------------------------

# fixed values: multipliers and shifts of a published 64-bit finaliser (splitmix)
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
ODD = U64(0x9E3779B97F4A7C15)
LONG = 256
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising bijection on 64 bits."""
    for shift, factor in MIX:
        x = (x ^ (x >> U64(shift))) * U64(factor)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, and from the end on, as numbers; there are zeros behind the end."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=raw, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans data[starts:ends]: each 8 bytes are mixed in by a bijection that depends on all
    before, so no sum of powers cancels out; spans of more than LONG bytes get a cryptographic hash."""
    there = eights(data)
    size = ends - starts
    h = mix((mix(size.astype(U64) * ODD + ODD) ^ (there[starts] & _FIRST[np.minimum(size, 8)])) * ODD)
    rows = np.flatnonzero(size > 8)
    for done in range(8, LONG, 8):
        if not len(rows):
            break
        h[rows] = mix((h[rows] ^ (there[starts[rows] + done] & _FIRST[np.minimum(size[rows] - done, 8)])) * ODD)
        rows = rows[size[rows] > done + 8]
    if len(rows):
        raw = data.tobytes()
        h[rows] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
    return h


# --- words -------------------------------------------------------------------------------------

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and n+1 offsets of the documents into them."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a slice, and the documents' offsets into them."""
    data = lowered(data)
    starts, ends, docs = word_spans(data, offsets)
    return span_hash(data, starts, ends), docs


def shingle_sets(words: np.ndarray, docs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as sorted 64-bit hashes, document by document, and n+1 offsets.

    A document of fewer than k words has its whole sequence as one shingle; one without words none.
    """
    n = np.diff(docs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.repeat(docs[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    size = np.minimum(np.repeat(n, count), k)
    h = np.full(len(first), 0x2545F4914F6CDD1D, dtype=U64)
    for i in range(k):
        there = i < size
        at = np.minimum(first + i, max(len(words) - 1, 0))
        h = np.where(there, mix(h + (words[at] if len(words) else h)) * ODD, h)
    h = mix(h + size.astype(U64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


# --- groups of rows ----------------------------------------------------------------------------


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group as one batch, from rows that are sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []

    def key(batch, row):
        return [batch.column(k)[row] for k in range(keys)]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        edge = np.zeros(n, dtype=bool)
        for k in range(keys):
            c = batch.column(k)
            edge[1:] |= pc.not_equal(c[1:], c[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        edge[0] = not held or key(batch, 0) != key(held[-1], held[-1].num_rows - 1)
        first = np.flatnonzero(edge)
        if not len(first) or first[0]:
            held.append(batch.slice(0, int(first[0]) if len(first) else n))
        for lo, hi in zip(first.tolist(), [*first.tolist(), n][1:], strict=True):  # none where the batch goes on with the held group
            if held:
                yield pa.concat_batches(held)
            held = [batch.slice(lo, hi - lo)]
    if held:
        yield pa.concat_batches(held)


# --- linked groups -----------------------------------------------------------------------------

HOT, MANY = 1000, 100_000  # fewer rows than MANY / HOT are a key of no weight


def hot_keys(rows: DataFrame, key: str, total: int, hot: int = HOT) -> list:
    """The keys that more than 1/hot of the rows have: fewer than `hot` ones, whatever the input."""
    return [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * hot > max(total, MANY)).select(key).collect()]


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join on key, which is unique in `table`. The rows of hot keys, a bounded number, meet the table's by a
    broadcast, so no key's rows are shuffled into one task; the other rows are shuffled."""
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(table.where(~is_hot), key).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key))


def components(edges: DataFrame, work: Work, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for nodes that have edges.

    Alternates min-label hooking with pointer jumping; every round is an aggregation with map-side combine and two
    lookups whose hot keys (hubs, large components) are spread. Rounds are written to shared storage.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = work.save(links.union(links.select("b", "a")).distinct(), "links")
    hubs = hot_keys(links, "b", links.count())
    label = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    label = work.save(label, "label")
    total = label.count()
    while True:
        near = looked_up(links, label.withColumnRenamed("node", "b"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = work.save(label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "hooked")
        # a label's own label: two steps at once
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = looked_up(hooked, up, "component", hot_keys(hooked, "component", total)).select("node", "old", F.least("component", "up").alias("component"))
        jumped = work.save(jumped, "label")
        work.drop(label, hooked)
        label = jumped
        if jumped.where("component <> old").isEmpty():
            work.drop(links)
            return jumped.select("node", "component")
        label = jumped.select("node", "component")


# --- row identity ------------------------------------------------------------------------------


def numbered(keys: DataFrame, *order: str) -> DataFrame:
    """Distinct rows with a number that rises in their order: the part of a range partitioning, then the place there."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "uid"])
            at += batch.num_rows

    return keys.distinct().repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("uid", T.LongType())]))


def with_uid(docs: DataFrame, work: Work, keep: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, text) with null texts empty; uid orders rows as doc_id does and is never null.

    Where no doc_id is null or repeated, it is the uid itself. Otherwise the distinct (doc_id, text)
    are numbered in order, nulls first: repeated rows share a uid, other rows of one doc_id don't. With `keep` the
    numbers outlive `work`.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    names = work.save(numbered(hashed.select(F.col("doc_id").alias("d"), F.col("h").alias("g")), "d", "g"), "uid")
    if keep:
        work.keep(names)
    return hashed.join(names, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("uid", "doc_id", "text")
