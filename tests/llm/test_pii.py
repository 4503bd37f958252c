import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from mnemora.llm.pii import base_spans, luhn, sanitise, span_report
from tests.llm.cases import SCHEMA, documents, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.groups())]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()é%\n", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert [s[:3] for s in base_spans(text)] == brute(text)


def test_report_on_the_bench_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds = ["email", "ip", "card", "phone"]
    want = {}
    for r in docs.select("doc_id", "text").collect():
        spans = brute(r.text or "")
        line = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        want[r.doc_id] = (*[sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(line.encode()).hexdigest(), spans)
    rows = span_report(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        *counts, digest, spans = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest
        shown = {tuple(s.split(":")) for s in r.spans.split(",") if s}
        assert {(kinds[k], str(s), str(e)) for s, k, e in spans} <= shown
        assert len(shown) == len(spans) + r.n_term


def people(spark):
    rows = [(i, f"Please ask agent Zorblax at zorblax@example.org about order {i} today", "", "", 0, "", "") for i in range(6)]
    rows += [(100 + i, f"The order number {i} was about nothing today and we ask again", "", "", 0, "", "") for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_terms_that_disclose_are_found_and_common_ones_not(spark):
    rows = {r.doc_id: r for r in span_report(people(spark)).collect()}
    text = "Please ask agent Zorblax at zorblax@example.org about order 0 today"
    terms = {text[int(s) : int(e)] for k, s, e in (x.split(":") for x in rows[0].spans.split(",")) if k == "term"}
    assert "Zorblax" in terms and "agent" in terms
    assert not terms & {"about", "order", "today", "ask"}
    assert all(rows[100 + i].spans == "" for i in range(60))


def test_sanitised_text(spark):
    rows = {r.doc_id: r.text for r in sanitise(people(spark)).collect()}
    assert rows[0].count("[EMAIL]") == 1 and "Zorblax" not in rows[0] and "about order 0 today" in rows[0]
    assert rows[100] == "The order number 0 was about nothing today and we ask again"


def test_odd_rows(spark):
    assert span_report(empty(spark)).count() == 0 and sanitise(empty(spark)).count() == 0
    docs = documents(spark, 15, 30)
    twice = docs.union(docs)
    assert span_report(twice).count() == twice.count()
    out = sanitise(twice)
    assert out.columns == docs.columns and out.count() == twice.count()
    assert [r.text for r in out.where("doc_id = 300").collect()] == [None, None]


def test_terms_are_found_far_from_the_entity_and_without_it(spark):
    gap = "and so we say again that all of this was about nothing in the end"
    far = f"Quuxfrob!!!! é {gap} write zorblax@example.org, {gap}; ((((Zorblax)))) left"
    rows = [(i, far) for i in range(6)] + [(50, "about nothing: Quuxfrob again")] + [(100 + i, f"x{i} {gap} and we write {gap} left") for i in range(80)]
    docs = spark.createDataFrame([(i, t, "", "", 0, "", "") for i, t in rows], SCHEMA)
    found = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in span_report(docs).collect()}
    words = lambda i, t: [t[int(s) : int(e)] for k, s, e in found[i] if k == "term"]
    assert words(0, far) == ["Quuxfrob", "Zorblax"]
    assert words(50, rows[6][1]) == ["Quuxfrob"]  # 6 of 7 documents with it have the email: generalised
    assert not any(found[100 + i] for i in range(80))
    text = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert text[50] == "about nothing: [TERM] again" and text[0].endswith("(((())))" + " left") and text[0].startswith("[TERM]!!!!")
    twice = span_report(docs.withColumn("doc_id", F.when(F.col("doc_id") >= 6, F.col("doc_id"))).union(docs.where("doc_id < 6")))
    assert twice.count() == 93


def test_columns_with_the_names_that_the_join_uses(spark):
    rows = [(1, "write to ann.lee@mail.example now", "a", "b", "c", "d"), (2, "nothing here", "e", "f", "g", "h"), (3, None, "i", "j", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rowd string, rowr string, row_ string, spans string")
    out = {r.doc_id: tuple(r) for r in sanitise(docs).collect()}
    assert out == {1: (1, "write to [EMAIL] now", *rows[0][2:]), 2: rows[1], 3: rows[2]}
