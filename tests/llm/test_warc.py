import base64
import hashlib
import io
import struct

import pytest
import zstandard

from mnemora.llm.warc import DICT_MAGIC, WarcError, read_archives, read_records, record, sha1_base32, train, warc_round_trip, write_archives
from tests.llm.cases import rows_of

SCHEMA = "page_id long, url string, html string, digest string, newest long"


def pages(spark):
    rows = [(1, "http://a", "same", "", 0), (2, "http://b", "same", "", 0), (9, None, "same", "", 0), (3, "http://c", "", "", 0), (4, "http://d", None, "", 0), (5, "http://e\r\nX: y", "é" * 3000, "", 0), (6, "u", "x" * 200_000, "", 0), (None, "n", "alone", "", 0)]
    rows += [(100 + i, "http://p", "hot page", "", 0) for i in range(200)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, least=0):
    newest = {}
    for page, html in rows:
        if page is not None:
            newest[html] = max(newest.get(html, page), page)
    out = []
    for page, html in rows:
        raw = html.encode()
        revisit = len(raw) >= least and page != newest.get(html)
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", newest[html] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = pages(spark)
    got = sorted((tuple(r) for r in warc_round_trip(df, min_revisit_bytes=least).drop("url").collect()), key=str)
    assert got == brute([(r.page_id, r.html or "") for r in df.collect()], least)


def test_bench_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = rows_of(warc_round_trip(df).drop("url"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(got, key=str) == brute([(r.page_id, r.html or "") for r in df.collect()])


def test_payloads_come_back(spark, tmp_path):
    df = pages(spark)
    folder = f"file://{tmp_path}/w"
    index = write_archives(df, folder)
    found = {}
    for file in (tmp_path / "w").glob("*.warc.zst"):
        for head, block in read_records(file.open("rb")):
            if head["warc-type"] == "response":
                found[head["warc-record-id"]] = block.decode()
    assert found["<urn:page:6>"] == "x" * 200_000 and found["<urn:page:5>"] == "é" * 3000 and found["<urn:page:9>"] == "same"
    assert read_archives(index, folder).count() == df.count()


def archive(data=None, magic=DICT_MAGIC):
    dictionary = train([b"abc"])
    raw = dictionary.as_bytes()
    one = data if data is not None else record(1, "u", b"body", sha1_base32(b"body"), None, False)
    return struct.pack("<II", magic, len(raw)) + raw + zstandard.ZstdCompressor(dict_data=dictionary).compress(one)


def test_good_archive():
    [(head, block)] = read_records(io.BytesIO(archive()))
    assert block == b"body" and head["warc-target-uri"] == "u"


GOOD = record(1, "u", b"body", sha1_base32(b"body"), None, False)


@pytest.mark.parametrize(
    "broken",
    [
        archive(magic=0x184D2A50), archive()[:-5], b"", archive() + b"rubbish!", archive(GOOD.replace(b"WARC/1.1", b"WARC/9.9")), archive(GOOD.replace(b"Content-Length: 4", b"Content-Length: 5")),
        archive(GOOD.replace(b"body", b"BODY")), archive(GOOD.replace(b"WARC-Date", b"X-Date")), archive(GOOD[:-4]), archive(GOOD.replace(b"WARC-Type: response", b"WARC-Type response")),
    ],
)
def test_faulty_archives_are_refused(broken):
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(broken)))


def test_empty(spark):
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
