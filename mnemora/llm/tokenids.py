"""Operator 9: token ids in Arrow files of fixed-size-list batches.

A shard is a run of documents in ascending doc_id order; its ids form one stream, cut into
sequences of equal length. The file (Arrow IPC with footer, uncompressed) holds batches of two
fixed-size-list columns, `input_ids` and `attention_mask`; a memory map gives any sequence without
a copy, since batch and row follow from the position by division. The index table says where each
document's ids lie. Shards are written under a name of the attempt's own and then renamed, so a task
that runs again after a lost executor leaves one whole file.

Null texts count as empty (they hold the end id alone), a null doc_id sorts first, rows of one doc_id
are in order of a hash of the text, repeated rows are kept, other columns are ignored, and an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.llm.common import per_slice, saved, scratch
from mnemora.llm.tokens import SLICE, encoder, with_end

SEQ_LEN = 2048
SEQS_PER_BATCH = 256
END_ID = 1


def file_schema(seq_len: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(id_type, seq_len)), ("attention_mask", pa.list_(pa.bool_(), seq_len))])


class ShardWriter:
    """Streams ids into equal-length sequences; what doesn't fill the last one is masked."""

    def __init__(self, folder: str, seq_len: int, id_type: pa.DataType):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.arrow"
        self.seq_len, self.schema = seq_len, file_schema(seq_len, id_type)
        self.id_type = id_type
        self.sink = self.fs.open_output_stream(f"{self.folder}/_{self.name}")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.written = 0

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, type=t), self.seq_len) for x, t in ((ids.astype(self.id_type.to_pandas_dtype()), self.id_type), (mask, pa.bool_()))]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> int:
        """Returns the place of the first of these ids in the shard's stream."""
        at = self.written + self.held
        self.rest.append(ids)
        self.held += len(ids)
        size = self.seq_len * SEQS_PER_BATCH
        if self.held >= size:
            stream = np.concatenate(self.rest)
            full = len(stream) // size * size
            for lo in range(0, full, size):
                self._batch(stream[lo : lo + size], size)
            self.rest, self.held = [stream[full:]], len(stream) - full
            self.written += full
        return at

    def close(self) -> tuple[str, int]:
        total = self.written + self.held
        if self.held:
            stream = np.concatenate(self.rest)
            padded = np.zeros(-(-len(stream) // self.seq_len) * self.seq_len, dtype=stream.dtype)
            padded[: len(stream)] = stream
            self._batch(padded, len(stream))
        self.writer.close()
        self.sink.close()
        self.fs.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
        return self.name, total


class ShardReader:
    """Random access to a shard by sequence number or by place in its stream."""

    def __init__(self, folder: str, name: str, seq_len: int = SEQ_LEN):
        fs, path = pafs.FileSystem.from_uri(folder)
        path = f"{path}/{name}"
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = seq_len
        self.at: int | None = None

    def _load(self, number: int) -> np.ndarray:
        if number != self.at:
            batch = self.file.get_batch(number)
            self.at, self.mask = number, batch.column(1).flatten()
            self.flat = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        flat = self._load(number // SEQS_PER_BATCH)
        lo = number % SEQS_PER_BATCH * self.seq_len
        return flat[lo : lo + self.seq_len], self.mask.slice(lo, self.seq_len).to_numpy(zero_copy_only=False)

    def ids(self, start: int, length: int):
        """The pieces of a span of the stream, one per batch that it touches."""
        size = self.seq_len * SEQS_PER_BATCH
        while length > 0:
            flat = self._load(start // size)
            lo = start % size
            piece = flat[lo : lo + length]
            yield piece
            start, length = start + len(piece), length - len(piece)


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, vocabulary: int = 49_408) -> DataFrame:
    """Writes the shards and returns their index: shard, file, doc_id, place (in the shard), n_tokens."""
    id_type = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    schema = "shard int, file string, nth long, doc_id long, place long, n_tokens long"

    def write(batches):
        writer, nth = None, 0
        shard = TaskContext.get().partitionId()
        out = []
        for batch in batches:
            for i, j, data, offsets in per_slice(batch.column(1), SLICE):
                writer = writer or ShardWriter(folder, seq_len, id_type)
                ids, bounds = with_end(*encoder(tokenizer).encode(data, offsets), end_id)
                place = writer.add(ids)
                out.append((batch.column(0).slice(i, j - i), np.arange(nth, nth + j - i), place + bounds[:-1], np.diff(bounds)))
                nth += j - i
        if writer:
            name, _ = writer.close()
            for doc_id, n, place, size in out:
                yield pa.record_batch([pa.array(np.full(len(n), shard), type=pa.int32()), pa.array([name] * len(n)), pa.array(n), doc_id.cast(pa.int64()), pa.array(place), pa.array(size)], names=["shard", "file", "nth", "doc_id", "place", "n_tokens"])

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("hash"), F.spark_partition_id().alias("part"))
    # rows of one doc_id, null too, and repeated rows are no single task's: the ranges part them as well
    dealt = rows.repartitionByRange("doc_id", "hash", "part").sortWithinPartitions("doc_id", "hash", "part").select("doc_id", "text")
    return saved(dealt.mapInArrow(write, schema), "token-index")


def read_token_shards(index: DataFrame, folder: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Reads every document's ids back from the files: doc_id, start, n_tokens, ids_crc32."""
    total = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("total"))
    # one row per file: a running sum over the files, not over the documents
    base = total.select("shard", "file", F.coalesce(F.sum("total").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        reader, name = None, None
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("file", "place", "n_tokens", "base")}
            crc = np.zeros(batch.num_rows, dtype=np.int64)
            for k, (file, place, size) in enumerate(zip(rows["file"], rows["place"], rows["n_tokens"], strict=True)):
                if file != name:
                    reader, name = ShardReader(folder, file, seq_len), file
                for piece in reader.ids(place, size):
                    crc[k] = zlib.crc32(piece.astype("<u4").tobytes(), int(crc[k]))
            start = np.array(rows["base"]) + np.array(rows["place"])
            yield pa.record_batch([batch.column("doc_id"), pa.array(start), batch.column("n_tokens"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = index.join(base, ["shard", "file"]).select("file", "place", "n_tokens", "doc_id", "base")
    return joined.mapInArrow(read, schema)


def token_ids(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    folder = folder or scratch(docs.sparkSession, "token-shards")
    index = write_token_shards(docs, folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"), seq_len)
    return read_token_shards(index, folder, seq_len)
