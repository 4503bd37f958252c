from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from mnemora.functions import documents as N
from mnemora.functions import text as X
from mnemora.functions import times as T
from mnemora.functions import vectors as V
from mnemora.functions.fuzzy import common_length, token_sort_ratio

NOW = datetime(2026, 6, 17, 12, tzinfo=UTC)  # a Wednesday


def value(spark, column, **fields):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]) if fields else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("query", "start", "end"),
    [
        ("between January and March 2026", "2026-01-01", "2026-03-01"), ("since May 2025", "2025-05-01", "2026-06-17"), ("in February 2024", "2024-02-01", "2024-02-29"), ("a week ago", "2026-06-10", "2026-06-10"),
        ("2 months ago", "2026-04-18", "2026-04-18"), ("over the last 10 days", "2026-06-07", "2026-06-17"), ("this week", "2026-06-15", "2026-06-17"), ("this quarter", "2026-04-01", "2026-06-17"), ("what did i do recently", "2026-06-03", "2026-06-17"),
        ("a couple of months ago", "2026-04-18", "2026-06-17"), ("last week", "2026-06-08", "2026-06-14"), ("last month", "2026-05-01", "2026-05-31"), ("last year", "2025-01-01", "2025-12-31"), ("last quarter", "2026-01-01", "2026-03-31"),
        ("yesterday", "2026-06-16", "2026-06-16"), ("today", "2026-06-17", "2026-06-17"), ("last wednesday", "2026-06-10", "2026-06-10"), ("on friday", "2026-06-12", "2026-06-12"), ("the 1999 report", "1999-01-01", "1999-12-31"),
    ],
)
def test_temporal_range(query, start, end):
    lo, hi = T.temporal_range(query, NOW)
    assert (f"{lo:%Y-%m-%d %H:%M:%S}", f"{hi:%Y-%m-%d %H:%M:%S.%f}") == (f"{start} 00:00:00", f"{end} 23:59:59.999000")


@pytest.mark.parametrize("query", ["", "plain words", "current version of this week", "how to bake bread today", "explain yesterday"])
def test_no_temporal_range(query):
    assert T.temporal_range(query, NOW) is None


def test_personal_how_queries_keep_their_time():
    assert T.temporal_range("how do i feel today", NOW)


@pytest.mark.parametrize(
    ("content", "day"),
    [("met her yesterday", "2026-06-16"), ("tomorrow", "2026-06-18"), ("a few days ago", "2026-06-14"), ("2 weeks ago", "2026-06-03"), ("in 3 days", "2026-06-20"), ("last monday", "2026-06-19"), ("last wednesday", "2026-06-10"),
     ("next monday", "2026-06-22"), ("next wednesday", "2026-06-24"), ("last week", "2026-06-08"), ("next month", "2026-07-01"), ("last month", "2026-05-01"), ("nothing", None)],
)
def test_event_dates(spark, content, day):
    got = value(spark, F.date_format(T.infer_event_date(F.lit(content), F.lit(NOW)), "yyyy-MM-dd"))
    assert got == day


def test_weekday_rule_without_legacy(spark):
    assert str(value(spark, T.infer_event_date(F.lit("last monday"), F.lit(NOW), legacy_weekday=False))) == "2026-06-15"


def test_recency_and_persistence(spark):
    day = lambda n: F.lit(NOW) - F.expr(f"interval {n} days")
    none = F.lit(None).cast("timestamp")
    assert value(spark, T.recency(day(73), none, F.lit(False), F.lit(NOW))) == pytest.approx(0.8)
    assert value(spark, T.recency(none, day(73), F.lit(False), F.lit(NOW))) == 0.5
    assert value(spark, T.recency(none, day(73), F.lit(True), F.lit(NOW))) == pytest.approx(0.8)
    assert value(spark, T.recency(day(9999), none, F.lit(False), F.lit(NOW))) == pytest.approx(0.2)
    assert value(spark, T.persistence(F.lit(None).cast("double"), day(0), F.lit(4), day(1), F.lit(NOW))) == pytest.approx(0.5 + 0.1 * 2 / 2)
    assert value(spark, T.edge_recency(none, none, F.lit(NOW))) == 1.0
    assert value(spark, T.proximity(day(5), day(10), day(0))) == pytest.approx(1.0)
    assert value(spark, T.proximity(day(11), day(10), day(0))) == 0.0


def test_text(spark):
    assert sorted(value(spark, X.tokenize(F.lit("The Cat's über-hat, a CAT_1 and the cat")))) == ["ber", "cat", "cat_1", "hat"]
    assert value(spark, X.relation_name(F.lit("  works - for  users--uses "))) == "WORKS_FOR_USERS_USES"
    assert value(spark, X.slug(F.lit(" Hello, World! "))) == "hello-world"
    assert value(spark, X.word_count(F.lit("  a  b ")))== 2 and value(spark, X.word_count(F.lit("  "))) == 0
    assert value(spark, X.intent(F.lit("What is MY  favorite?"))).name == "PREFERENCE"
    assert value(spark, X.intent(F.lit("who is Bob"))).name == "ENTITY_LOOKUP"
    assert value(spark, X.intent(F.lit("weather report"))).confidence == 0
    assert value(spark, X.revision_adjustment(F.lit("Is it still red?"), F.lit("It changed"))) == 0.15
    assert value(spark, X.revision_adjustment(F.lit("Is it still red?"), F.lit("It is red"))) == -0.25
    assert value(spark, X.revision_adjustment(F.lit("red?"), F.lit("It changed"))) == 0
    assert value(spark, X.escape_tags(F.lit("<a>&"))) == "&lt;a&gt;&amp;"
    assert value(spark, X.bounded_terms(F.lit(" ".join(["x" * 65, *["w"] * 200])))) == ["w"] * 96
    assert value(spark, X.decode_cursor(F.lit("!!!"))) is None
    back = value(spark, X.decode_cursor(X.encode_cursor(F.lit("2024-01-01 00:00:00"), F.lit(7))))
    assert (back["at"], back["key"]) == ("2024-01-01 00:00:00", "7")
    assert value(spark, X.matches_all(F.lit("Red Fox"), F.array(F.lit("red"), F.lit("FOX")), F.array(F.lit("hen"))))
    assert value(spark, X.without_nul(F.lit("a\0b"))) == "ab"


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, V.norm(a)) == 5 and value(spark, V.normalized(z)) == [0, 0]
    assert value(spark, V.cosine(a, z)) == 0 and value(spark, V.guarded_cosine(z, a)) is None
    assert value(spark, V.dot(a, F.array(F.lit(2.0)))) == 6
    assert value(spark, V.clamped(F.lit(float("nan")))) == 0 and value(spark, V.clamped(F.lit(3.0))) == 1
    assert value(spark, V.unit_score(F.lit(1.2))) is None
    assert value(spark, V.percent_delta(F.lit(0.0), F.lit(5.0))) is None and value(spark, V.percent_delta(F.lit(4.0), F.lit(5.0))) == 25


def test_json(spark):
    meta = F.lit('{"session_id": "s1", "n": 7, "x": 5}')
    assert value(spark, N.string_field(meta, "session_id")) == "s1" and value(spark, N.string_field(meta, "n")) is None
    assert value(spark, N.int_field(meta, "n")) == 7 and value(spark, N.int_field(meta, "absent")) == 0
    assert value(spark, N.as_map(N.without(N.merged(meta, n=F.lit(8)), "x"))) == {"session_id": "s1", "n": "8"}
    assert value(spark, N.as_map(F.lit("[1]"))) == {}
    assert value(spark, N.contains_id(F.lit("[1, 2]"), F.lit(2))) and not value(spark, N.contains_id(F.lit("x"), F.lit(2)))
    nested = value(spark, N.log_record(F.lit('"{\\"a\\": 1}"'), "a int"))
    assert nested.a == 1


def test_fuzzy():
    assert token_sort_ratio("John Smith", "smith, JOHN") == 100
    assert token_sort_ratio("", "x") == 0
    assert common_length("abcbdab", "bdcaba") == 4
    assert token_sort_ratio("new york mets", "new york meats") == 96


def test_iso_dates(spark):
    at = lambda s: value(spark, F.date_format(T.parse_iso(F.lit(s)), "yyyy-MM-dd HH:mm"))
    assert at("2026-06-01T00:00:00") == "2026-06-01 00:00" and at("2026-06-01 10:00") == "2026-06-01 10:00"
    assert at("2026-06-01T00:00:00+02:00") == "2026-05-31 22:00" and at("0000-01-01") is None and at("soon") is None
