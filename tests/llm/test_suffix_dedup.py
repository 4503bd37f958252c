import hashlib

import pytest

from mnemora.llm.suffix_dedup import remove_repeats
from tests.llm.cases import SCHEMA, documents, empty, rows_of, texts


def brute(docs, length):
    seen, out = set(), []
    for k in sorted(docs):
        raw = docs[k].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("spread", [64, 1])
def test_equals_brute_force(spark, spread):
    docs = documents(spark, 5, 90)
    want = brute(texts(docs), 100)
    assert rows_of(remove_repeats(docs, spread=spread), *COLUMNS) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_periodic_and_overlapping(spark):
    rows = [(1, "ab" * 400), (2, "x" + "ab" * 150 + "y" + "ba" * 120), (3, "q" * 99), (4, "q" * 99), (5, "q" * 100), (6, "head" + "z1z2z3" * 40), (7, "tail" + "z1z2z3" * 40 + "w" * 120)]
    docs = spark.createDataFrame([(i, t, "", "", 0, "", "") for i, t in rows], SCHEMA)
    assert rows_of(remove_repeats(docs), *COLUMNS) == brute(dict(rows), 100)


def test_kept_bytes_and_empty(spark):
    assert remove_repeats(empty(spark)).count() == 0
    docs = documents(spark, 6, 30)
    for r in remove_repeats(docs).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
