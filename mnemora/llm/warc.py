"""Operator 7: WARC archives in Zstandard, one frame per record, with the dictionary in a leading
skippable frame.

Writing: records of equal payload digest are one group, found by a map-side combined maximum of
page_id; the row with the largest page_id becomes the response, the others revisit it. Back at the rows,
the digests of very common payloads (a bounded number) are broadcast, the others joined by a shuffle. Reading: the dictionary frame is loaded, then one frame per record is decoded; the
version line, the required headers, the content length, the closing blank lines and a response's
digest are validated, and a faulty archive raises WarcError.

A null html is an empty payload; a null url gives no target header; a null page_id comes before all
others; rows that repeat the page_id and payload of a response are responses too; other columns are
ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import HOT, MANY, looked_up, saved, scratch

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICT_BYTES = 16 << 10
DICT_SAMPLES = 256
SAMPLE_BYTES = 4096
LEVEL = 3
MIN_REVISIT_BYTES = 0
VERSION = b"WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    block = b"" if revisit else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    def __init__(self, folder: str, samples: list[bytes]):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.sink = self.fs.open_output_stream(f"{self.path}/_{self.name}", compression=None)  # frames are compressed one by one
        dictionary = train(samples)
        raw = dictionary.as_bytes()
        self.sink.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        self.records = 0

    def add(self, data: bytes) -> None:
        self.sink.write(self.compressor.compress(data))
        self.records += 1

    def close(self) -> str:
        self.sink.close()
        self.fs.move(f"{self.path}/_{self.name}", f"{self.path}/{self.name}")
        return self.name


class _Buffer:
    """A growing window over a file: only what the current frame needs is held."""

    def __init__(self, source, step: int = 1 << 20):
        self.source, self.step = source, step
        self.data, self.at, self.offset = b"", 0, 0

    def has(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            more = self.source.read(max(self.step, n))
            if not more:
                return False
            self.data, self.offset, self.at = self.data[self.at :] + more, self.offset + self.at, 0
        return True

    def peek(self, lo: int, n: int) -> bytes:
        if not self.has(lo + n):
            raise WarcError(f"the file ends within a frame at byte {self.offset + self.at}")
        return self.data[self.at + lo : self.at + lo + n]

    def take(self, n: int) -> bytes:
        out = self.peek(0, n)
        self.at += n
        return out


def frame_length(buffer: _Buffer) -> int:
    """Length of the frame that begins here, from its header and its blocks' headers."""
    if struct.unpack("<I", buffer.peek(0, 4))[0] != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {buffer.offset + buffer.at}")
    flags = buffer.peek(4, 1)[0]
    single = flags >> 5 & 1
    size = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(buffer.peek(size, 3), "little")
        size += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return size + 4 * (flags >> 2 & 1)


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, validated."""
    buffer = _Buffer(source)
    if not buffer.has(8):
        raise WarcError("no dictionary frame")
    magic, size = struct.unpack("<II", buffer.take(8))
    if magic != DICT_MAGIC:
        raise WarcError("the archive doesn't begin with a dictionary frame")
    raw = buffer.take(size)
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while buffer.has(1):
        where = buffer.offset + buffer.at
        data = decoder.decompressobj().decompress(buffer.take(frame_length(buffer)))
        head, gap, rest = data.partition(b"\r\n\r\n")
        first, _, lines = head.partition(b"\r\n")
        if first != VERSION or not gap:
            raise WarcError(f"record at byte {where}: bad version line or header end")
        fields = {}
        for line in lines.decode("utf-8", "surrogatepass").split("\r\n"):
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"record at byte {where}: header line without colon")
            fields[name.strip().lower()] = value.strip()
        for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
            if name not in fields:
                raise WarcError(f"record at byte {where}: no {name}")
        length = fields["content-length"]
        if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
            raise WarcError(f"record at byte {where}: content length {length}, {len(rest) - 4} bytes found")
        block = rest[:-4]
        if fields["warc-type"] == "response" and fields.get("warc-payload-digest") != f"sha1:{sha1_base32(block)}":
            raise WarcError(f"record at byte {where}: digest doesn't match")
        if fields["warc-type"] == "revisit" and "warc-refers-to" not in fields:
            raise WarcError(f"record at byte {where}: revisit without target")
        yield fields, block


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes one archive per task and returns (file, records)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    newest = rows.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    total = pages.count()
    hot = [r.digest for r in newest.where(F.col("n") * HOT > max(total, MANY)).select("digest").collect()]
    grouped = looked_up(rows, newest.drop("n"), "digest", hot).select("page_id", "url", "html", "newest")

    def write(batches):
        writer = None
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            if batch.num_rows and writer is None:
                step = max(1, batch.num_rows // DICT_SAMPLES)
                samples = [record(None, u, h.encode(), sha1_base32(b""), None, False)[:SAMPLE_BYTES] for u, h in zip(columns[1][::step].to_pylist(), columns[2][::step].to_pylist(), strict=True)]
                writer = ArchiveWriter(folder, samples)
            for lo in range(0, batch.num_rows, 256):
                for page, url, html, newest in zip(*(c.slice(lo, 256).to_pylist() for c in columns), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    revisit = len(payload) >= min_revisit_bytes and page != newest
                    writer.add(record(page, url, payload, sha1_base32(payload), newest, revisit))
        if writer:
            name, n = writer.close(), writer.records
            yield pa.record_batch([pa.array([name]), pa.array([n])], names=["file", "records"])

    return saved(grouped.mapInArrow(write, "file string, records long"), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives, in any order."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        for batch in batches:
            fs, path = pafs.FileSystem.from_uri(folder)
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for h, _ in read_records(source):
                        target = h.get("warc-refers-to")
                        rows.append((page_of(h["warc-record-id"]), h.get("warc-target-uri"), int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], page_of(target) if target else None))
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = index.count()
    return index.select("file").repartition(max(1, files)).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_revisit_bytes), folder)
