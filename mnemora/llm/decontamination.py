"""Operator 3: benchmark decontamination by template canonicalisation.

Words become template words: numbers, names (capitalised within a sentence) and units (after a number)
turn into typed placeholders, all else is lower-cased and stripped of punctuation. Windows of 5
template words of the documents, those with PLAIN ordinary words at least, are hash-joined with those of
the benchmark. (A window of placeholders fits any table of numbers or list of names: it tells nothing.)
Hits are lined up by the distance between their places; within a line each slot of the item (the value a
placeholder stands for) must map to one value of the document: a re-parameterised question does, chance
hits don't. An item leaks into a document if the consistent lines cover at least COVERAGE of its words.

The benchmark's windows are broadcast only while there are at most BROADCAST_WINDOWS of them (counted
first); beyond that all windows of the documents are shuffled and joined, the hottest windows (a bounded
number) apart from the others. Both ways give the same rows.

Null texts count as empty; items of fewer than 5 words have no window and can't leak; rows of one item_id
with different texts are items of their own, told by the one id; an item without id is called `null`;
repeated items are one; repeated documents get the same result each, whatever the doc_id, null too; other
columns are ignored; an empty table gives no rows, and without items nothing is contaminated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import HOT, U64, Work, list_array, lowered, mix, on_batches, per_slice, signed, span_hash, with_uid, word_spans

WINDOW, PLAIN = 5, 2
COVERAGE = 0.5
CONSISTENT = 0.8
BROADCAST_WINDOWS = 1_000_000
SALTS = 32

# fixed values: words that count as units after a number
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec min h hr hrs d day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms pound pounds liter liters litre litres inch inches foot feet "
    "dollar dollars euro euros cent cents percent degree degrees hz khz mhz ghz b kb mb gb tb w kw v mol pa k c f"
).split()
NUMBER, NAME, UNIT = (mix(np.array([k], dtype=U64))[0] for k in (101, 102, 103))

_SOLID = np.ones(256, dtype=bool)
_SOLID[0x21:0x30] = _SOLID[0x3A:0x41] = _SOLID[0x5B:0x61] = _SOLID[0x7B:0x7F] = False
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?:;|\"")] = True


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(span_hash(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(r) for r in raw], ends))


UNIT_HASHES = _unit_hashes()


def template_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, value, bounds): value is the word behind a placeholder, 0 for plain words."""
    starts, ends, bounds = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, U64), bounds
    solid = np.concatenate(([0], np.cumsum(_SOLID[data])))
    digits = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
    index = np.arange(len(data))
    # the word without punctuation around it
    following = np.minimum.accumulate(np.where(_SOLID[data], index, len(data))[::-1])[::-1]
    previous = np.maximum.accumulate(np.where(_SOLID[data], index, -1))
    bare = solid[ends] == solid[starts]
    lo = np.where(bare, starts, following[starts])
    hi = np.where(bare, ends, previous[ends - 1] + 1)
    word = span_hash(lowered(data), lo, hi)
    number = (digits[hi] > digits[lo]) & (data[lo] >= 0x30) & (data[lo] <= 0x39)
    first = np.zeros(len(starts), dtype=bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    after_stop = np.concatenate(([True], _STOPS[data[ends[:-1] - 1]]))
    breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
    new_line = np.concatenate(([True], breaks[starts[1:]] > breaks[ends[:-1]]))
    upper = (data[lo] >= 0x41) & (data[lo] <= 0x5A)
    second = data[np.minimum(lo + 1, len(data) - 1)]
    name = upper & (hi - lo > 1) & (second >= 0x61) & ~(first | after_stop | new_line)
    before = np.concatenate(([False], number[:-1])) & ~first
    at = np.minimum(np.searchsorted(UNIT_HASHES, word), len(UNIT_HASHES) - 1)
    unit = before & ~number & (UNIT_HASHES[at] == word)
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, word)))
    return template, np.where(number | unit | name, word | U64(1), U64(0)), bounds


def windows(template: np.ndarray, value: np.ndarray, bounds: np.ndarray, size: int = WINDOW, plain: int = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place) of every window with enough plain words."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[:-1][owner] + place
    h = np.full(len(at), 0x51ED270B, dtype=U64)
    for k in range(size):
        h = mix(h * U64(31) + template[at + k]) if len(at) else h
    ordinary = np.concatenate(([0], np.cumsum(value == 0)))
    enough = ordinary[at + size] - ordinary[at] >= plain
    return h[enough], owner[enough], place[enough]


def template_windows(rows: DataFrame, key: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, words, place, window, slots) of the windows of every text, or of the wanted ones only."""

    def kernel(batch):
        for i, j, data, offsets in per_slice(batch.column(1)):
            template, value, bounds = template_words(data, offsets)
            h, owner, place = windows(template, value, bounds)
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                hit = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, np.int64)
                h, owner, place = h[hit], owner[hit], place[hit]
            first = bounds[:-1][owner] + place
            for lo in range(0, len(h), 100_000):
                s = slice(lo, lo + 100_000)
                n = len(h[s])
                slots = value[(first[s][:, None] + np.arange(WINDOW)).ravel()] if n else value[:0]
                keys = batch.column(0).slice(i, j - i).take(pa.array(owner[s]))
                yield pa.record_batch([keys, pa.array(np.diff(bounds)[owner[s]]), pa.array(place[s]), pa.array(signed(h[s])), list_array(signed(slots), np.arange(n + 1) * WINDOW, pa.int64())], names=[key, "words", "place", "window", "slots"])

    return on_batches(rows, [key, "text"], kernel, f"{key} long, words long, place long, window long, slots array<long>")


def leaks(rows: DataFrame, benchmark: DataFrame, work: Work, coverage: float = COVERAGE, consistent: float = CONSISTENT, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(uid, item_id, covered): the items that leak into a document, and the covered part of their words."""
    items = with_uid(benchmark, work, key="item_id").dropDuplicates(["uid"]).select(F.col("uid").alias("item"), F.col("doc_id").alias("item_id"), "text")
    items = work.save(items, "items")
    wanted = template_windows(items, "item").select("item", F.col("words").alias("item_words"), F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots"))
    wanted = work.save(wanted, "wanted")
    total = wanted.count()
    if total <= most:
        hashes = np.unique(np.array([r[0] for r in wanted.select("window").distinct().collect()], dtype=np.int64).view(U64))
        hits = template_windows(rows, "uid", hashes).join(F.broadcast(wanted), "window")
    else:
        # a window that very many documents have is dealt by salt: its items' windows go to every salt
        known = template_windows(rows, "uid")
        often = work.save(known.groupBy("window").agg(F.count("*").alias("n")), "window-counts")
        hot = work.save(often.where(F.col("n") * HOT > (often.agg(F.sum("n")).first()[0] or 0)).select("window"), "hot-windows")
        salted = known.join(F.broadcast(hot), "window").withColumn("salt", F.pmod(F.xxhash64("uid", "place"), F.lit(SALTS)).cast("int"))
        spread = wanted.join(F.broadcast(hot), "window").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = known.join(F.broadcast(hot), "window", "left_anti").join(wanted, "window").unionByName(salted.join(spread, ["window", "salt"]).drop("salt"))
    hits = work.save(hits.select("uid", "item", "item_words", "item_place", "item_slots", "slots", (F.col("place") - F.col("item_place")).alias("line")), "hits")
    slots = hits.select("uid", "item", "line", F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).where("s.item_slots <> 0").select("uid", "item", "line", F.col("s.item_slots").alias("slot"), F.col("s.slots").alias("value"))
    per_slot = slots.groupBy("uid", "item", "line", "slot").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    torn = per_slot.groupBy("uid", "item", "line").agg(F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("agree")).where(F.col("agree") < consistent).select("uid", "item", "line")
    whole = hits.join(torn, ["uid", "item", "line"], "left_anti")
    covered = whole.select("uid", "item", "item_words", F.explode(F.sequence(F.col("item_place"), F.col("item_place") + WINDOW - 1)).alias("word")).groupBy("uid", "item", "item_words", "word").agg(F.lit(1).alias("one"))
    rate = F.count("*") / F.col("item_words")
    found = covered.groupBy("uid", "item", "item_words").agg(rate.alias("covered")).where(F.col("covered") >= coverage)
    return found.join(items.select("item", "item_id"), "item").select("uid", "item_id", "covered")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, comma-joined in order), covered (the largest part) for every row."""
    with Work(docs.sparkSession, "decontamination") as work:
        rows = with_uid(docs, work)
        ids = F.sort_array(F.collect_set(F.struct("item_id")))
        found = leaks(rows, benchmark, work, **options).groupBy("uid").agg(ids.alias("items"), F.max("covered").alias("covered"))
        out = rows.select("uid", "doc_id").join(found, "uid", "left")
        names = F.array_join(F.transform("items", lambda i: F.coalesce(i["item_id"].cast("string"), F.lit("null"))), ",")
        n = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long")
        return work.keep(out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), n.alias("n_items"), F.coalesce(names, F.lit("")).alias("items"), F.coalesce("covered", F.lit(0.0)).alias("covered")))
