"""Time expressions and rules; everything is UTC and every `now` is a parameter."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions.text import NON_TEMPORAL

DAY = 86_400

# fixed values: the words of the temporal ladder and what they stand for
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
FUZZY_DAYS = {
    "recently": 14, "lately": 14, "just now": 1, "the other day": 5, "not too long ago": 30, "not long ago": 30, "a while ago": 90, "a few days ago": 7,
    "a couple of days ago": 3, "a couple of weeks ago": 14, "a couple of months ago": 60,
}
FIXED_WORDS = {"last night": -1, "yesterday": -1, "today": 0, "this morning": 0, "this afternoon": 0, "this evening": 0, "tonight": 0, "tomorrow": 1}
COUNTED = [
    (r"\b(\d+)\s*days?\s+ago\b", -1),
    (r"\ba\s+few\s+days?\s+ago\b", -3),
    (r"\b(\d+)\s*weeks?\s+ago\b", -7),
    (r"\ba\s+week\s+ago\b", -7),
    (r"\b(\d+)\s*months?\s+ago\b", -30),
    (r"\ba\s+month\s+ago\b", -30),
    (r"\bin\s+(\d+)\s*days?\b", 1),
    (r"\bin\s+(\d+)\s*weeks?\b", 7),
    (r"\bin\s+(\d+)\s*months?\b", 30),
]
_M = "|".join(MONTHS)
_LOOSE = rf"((?:{_M})(?:\s+\d{{1,2}})?(?:\s*,?\s*20\d{{2}})?)"


# --- expressions -------------------------------------------------------------------------------


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / 1e6


def age_days(t: Column, now: Column) -> Column:
    return (seconds(now) - seconds(t)) / DAY


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def proximity(reference: Column, start: Column, end: Column) -> Column:
    """0.5 at the edges of the window to 1 at its centre, 0 outside."""
    half = F.greatest(seconds(end) - seconds(start), F.lit(1.0)) / 2
    distance = F.abs(seconds(reference) - (seconds(start) + half))
    return F.when(reference.between(start, end), 0.5 + 0.5 * clip(1 - distance / half, 0, 1)).otherwise(0.0)


def recency(event: Column, recorded: Column, use_recorded: Column, now: Column) -> Column:
    at = F.coalesce(event, F.when(use_recorded, recorded))
    return F.when(at.isNotNull(), clip(1 - age_days(at, now) / 365, 0.2, 1)).otherwise(0.5)


def persistence(importance: Column, created: Column, frequency: Column, accessed: Column, now: Column) -> Column:
    kept = F.coalesce(importance, F.lit(0.5)) * F.exp(-0.005 * age_days(created, now))
    gap = F.greatest(age_days(accessed, now), F.lit(60 / DAY))
    return clip(kept + F.when(frequency == 0, 0.0).otherwise(0.1 * F.sqrt(frequency) / (1 + F.sqrt(gap))), 0, 1)


def edge_recency(valid: Column, recorded: Column, now: Column) -> Column:
    at = F.coalesce(valid, recorded)
    return F.when(at.isNull(), 1.0).otherwise(clip(1 - F.greatest(age_days(at, now), F.lit(0.0)) / 365, 0.5, 1))


def parse_iso(c: Column) -> Column:
    """A timestamp; without an offset it is UTC. Null where it is none or its year isn't in 1..9999."""
    plain = F.trim(c)
    clock = F.when(plain.rlike(r"^[^T ]+[T ]\d{2}:\d{2}$"), F.concat(plain, F.lit(":00"))).otherwise(plain)
    zoned = F.when(clock.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.concat(F.translate(clock, " ", "T"), F.lit("Z"))).otherwise(plain)
    t = F.when(plain.rlike(r"^\d{4}-\d{2}(-\d{2}|$)"), F.try_to_timestamp(zoned))
    return F.when(F.year(t).between(1, 9999), t)


def session_times(session_date: Column, now: Column) -> Column:
    """(reference, recorded): the session's date where it is valid, else none and now."""
    at = parse_iso(session_date)
    return F.struct(at.alias("reference"), F.coalesce(at, now).alias("recorded"))


def days_between(start: str, end: str) -> list[str]:
    """All UTC days from start to end as YYYYMMDD, the folders of a log archive."""
    lo, hi = (datetime.fromisoformat(x).date() for x in (start, end))
    return [f"{lo + timedelta(k):%Y%m%d}" for k in range((hi - lo).days + 1)]


def period(now: datetime, days: int) -> tuple[str, str, str, str]:
    """(start, end, previous start, previous end) of an inclusive window of days that ends today."""
    end = now.date()
    start = end - timedelta(days - 1)
    return tuple(map(str, (start, end, start - timedelta(days), start - timedelta(1))))


# --- the temporal ladder of queries --------------------------------------------------------------


def _midnight(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def _last(t: datetime) -> datetime:
    return _midnight(t) + timedelta(days=1) - timedelta(milliseconds=1)


def _date(year: int, month: int, day: int = 1) -> datetime:
    # like a date made of parts that may overflow: 31 February is in March
    return datetime(year, month, 1, tzinfo=UTC) + timedelta(days=day - 1)


def _month(year: int, month: int) -> tuple[datetime, datetime]:
    start = _date(year, month)
    return start, _last(_date(year + month // 12, month % 12 + 1) - timedelta(days=1))


def _loose(text: str, now: datetime) -> datetime | None:
    if m := re.search(rf"\b({_M})\s+(20\d{{2}})\b", text):
        return _date(int(m[2]), MONTHS.index(m[1]) + 1)
    if m := re.fullmatch(rf"({_M})(?:\s+(\d{{1,2}}))?(?:\s*,?\s*(20\d{{2}}))?", text.strip()):
        return _date(int(m[3] or now.year), MONTHS.index(m[1]) + 1, int(m[2] or 1))
    return None


def temporal_range(query: str, now: datetime) -> tuple[datetime, datetime] | None:
    """The time window a query names: the first rule that fits, by a fixed order."""
    low = " ".join(query.split()).lower()
    if not low or any(re.search(p, low, re.ASCII) for p in NON_TEMPORAL):
        return None
    today, weekday = _midnight(now), now.weekday()
    quarter = (now.month - 1) // 3
    back = lambda n: today - timedelta(days=n)
    whole = lambda t: (_midnight(t), _last(t))
    find = lambda p: re.search(p, low, re.ASCII)
    if (m := find(rf"\bbetween\s+{_LOOSE}\s+(?:and|to|-)\s+{_LOOSE}\b")) and (a := _loose(m[1], now)) and (b := _loose(m[2], now)):
        return _midnight(a), _last(b)
    if m := find(rf"\bsince\s+({_M})\s+(20\d{{2}})\b"):
        return _date(int(m[2]), MONTHS.index(m[1]) + 1), _last(now)
    if m := find(rf"\b({_M})\s+(20\d{{2}})\b"):
        return _month(int(m[2]), MONTHS.index(m[1]) + 1)
    if m := find(r"(\d+|a)\s+(day|week|month|year)s?\s+ago"):
        return whole(back(UNIT_DAYS[m[2]] * (1 if m[1] == "a" else int(m[1]))))
    if m := find(r"(?:for|over|within|in|during)\s+the\s+(?:last|past)\s+(\d+)\s+(day|week|month|year)s?"):
        return back(int(m[1]) * UNIT_DAYS[m[2]]), _last(now)
    if m := find(r"\bthis\s+(week|month|year|quarter)\b"):
        starts = {"week": back(weekday), "month": _date(now.year, now.month), "quarter": _date(now.year, 3 * quarter + 1), "year": _date(now.year, 1)}
        return starts[m[1]], _last(now)
    if m := find(r"\b(" + "|".join(sorted(FUZZY_DAYS, key=len, reverse=True)) + r")\b"):
        return back(FUZZY_DAYS[m[1]]), _last(now)
    if "last week" in low:
        return back(weekday + 7), _last(back(weekday + 1))
    if "last month" in low:
        end = _date(now.year, now.month) - timedelta(days=1)
        return _date(end.year, end.month), _last(end)
    if "last year" in low:
        return _date(now.year - 1, 1), _month(now.year - 1, 12)[1]
    if "last quarter" in low:
        year, first = (now.year - 1, 10) if quarter == 0 else (now.year, 3 * quarter - 2)
        return _date(year, first), _month(year, first + 2)[1]
    if "yesterday" in low:
        return whole(back(1))
    if "today" in low:
        return whole(now)
    for k, name in enumerate(WEEKDAYS):
        if find(rf"\blast\s+{name}\b"):
            return whole(back((weekday - k) % 7 or 7))
    for k, name in enumerate(WEEKDAYS):
        if find(rf"\b(?:on|this)\s+{name}\b"):
            return whole(back((weekday - k) % 7))
    if m := find(r"\b(?:19|20|21)\d{2}\b"):
        return _date(int(m[0]), 1), _month(int(m[0]), 12)[1]
    return None


def temporal_range_column(query: Column, now: datetime) -> Column:
    """(start, end) as epoch milliseconds for a table of queries; distinct queries are parsed once a batch."""

    @F.pandas_udf("start long, end long")
    def parse(texts: pd.Series) -> pd.DataFrame:
        known = {t: temporal_range(t, now) for t in texts.dropna().unique()}
        ms = lambda r, k: None if r is None else round(r[k].timestamp() * 1000)
        return pd.DataFrame({name: pd.array([ms(known.get(t), k) for t in texts], dtype="Int64") for k, name in enumerate(("start", "end"))})

    return parse(query)


# --- event times of extracted facts --------------------------------------------------------------


def infer_event_date(content: Column, reference: Column, legacy_weekday: bool = True) -> Column:
    """The date that a text's relative wording names, from its reference time; null where there is none.

    With `legacy_weekday`, "last <weekday>" keeps its odd rule: it counts forward unless the weekdays match.
    """
    low, day = F.lower(content), F.to_date(reference)
    on = F.weekday(day)
    out = None

    def rule(test: Column, value: Column):
        nonlocal out
        out = F.when(test, value) if out is None else out.when(test, value)

    for word, offset in FIXED_WORDS.items():
        rule(low.rlike(rf"\b{word}\b"), F.date_add(day, offset))
    for pattern, unit in COUNTED:
        n = F.try_to_number(F.regexp_extract(low, pattern, 1), F.lit("9999999")).cast("int") if "(" in pattern else F.lit(1)
        rule(low.rlike(pattern), F.date_add(day, n * unit))
    named = rf"\b(last|next)\s+({'|'.join(WEEKDAYS)})\b"
    target = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.regexp_extract(low, named, 2)).cast("int") - 1
    ahead = F.pmod(target - on, F.lit(7))
    behind = F.pmod(on - target, F.lit(7))
    last = F.when(behind == 0, -7).otherwise(behind if legacy_weekday else -behind)
    rule(low.rlike(named), F.date_add(day, F.when(F.regexp_extract(low, named, 1) == "last", last).otherwise(F.when(ahead == 0, 7).otherwise(ahead)).cast("int")))
    monday, month = F.date_sub(day, on), F.trunc(day, "month")
    for word, week, months in (("last", -7, -1), ("this", 0, 0), ("next", 7, 1)):
        rule(low.rlike(rf"\b{word} week\b"), F.date_add(monday, week))
    for word, week, months in (("last", -7, -1), ("this", 0, 0), ("next", 7, 1)):
        rule(low.rlike(rf"\b{word} month\b"), F.add_months(month, months))
    return F.when(reference.isNotNull(), out)
