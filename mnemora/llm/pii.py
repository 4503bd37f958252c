"""Operator 4: information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) are personal data. What is protected is each entity (the literal address or
number), each kind of them, and having any at all. All words of a document outside of its base spans are its terms.
Corpus counts over all documents say how strongly a term t reveals what is protected, e: of n(t) documents with t,
n(e,t) have e too, so P(e|t) = n(e,t) / n(t), and each of them tells log2(P(e|t) / P(e)) bits. A term is telling if
it shares at least MIN_SUPPORT documents with e, P(e|t) >= DISCLOSE, it tells MIN_BITS at least, and all its documents
together tell more than chance could among as many terms as there are: log2(number of terms tested) + MARGIN bits.
A telling term is a span of kind `term` wherever it stands, in documents without e too: removed where P(e|t) >=
REMOVE for any e, generalised otherwise.

Some terms are entities themselves: keys, passwords, access tokens. A word of letters and digits is one if it
carries SELF_BITS at least under the corpus's own byte bigrams (counted over all documents): as much as a random
number of that length. It is a removed `term` span.

Counts are combined per task before they are shuffled, pairs are joined on (entity, term), and no group of documents
is collected. The telling terms reach the tasks as a filter of a fixed number of bits; the words that pass it are
joined with the terms.

Null texts count as empty. Rows of one doc_id, null too, with different texts are documents of their own, in the
counts and in the result; a row that repeats doc_id and text counts once and gets the same result each time. Other
columns are ignored by the report and kept by `sanitise`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Work, lowered, on_batches, per_slice, signed, span_hash, word_spans

KINDS = ["email", "ip", "card", "phone", "term"]
FILTER_BITS = 24
MIN_SUPPORT = 3
DISCLOSE, REMOVE, MIN_BITS, MARGIN = 0.5, 0.9, 3.0, 10.0
SELF_BITS, SELF_LENGTH = 64.0, 16
ANY = "any"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, so the possessive form finds the same spans in linear time
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")
_STRIP = ".,;:!?\"'()[]{}<>|*#"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, entity), by start and then kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((lo, 0, last, text[lo:last].lower()))
        at = text.find("@", max(at + 1, last))
    if _DIGITS.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                    found.append((m.start(), 1, m.end(), m.group()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGITS.sub("", m.group())) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end(), d))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(d := _NOT_DIGITS.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end(), d))
    found.sort()
    return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def terms_of(data: np.ndarray, offsets: np.ndarray):
    """(hash, text number, start, end, solid start, solid end, first byte, end byte) of the terms of a slice: its words
    without signs around them, of two characters or more. Places are characters of the slice; the solid ones include
    the signs."""
    low = lowered(data)
    begins, stops, bounds = word_spans(low, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    sign = np.zeros(256, dtype=bool)
    sign[list(_STRIP.encode())] = True
    at, kept = np.arange(len(low)), ~sign[low]
    following = np.minimum.accumulate(np.where(kept, at, len(low))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(kept, at, -1))
    starts = np.minimum(following[begins], stops)
    ends = np.maximum(preceding[stops - 1] + 1, starts)
    place = char_places(data)
    there = place[ends] - place[starts] >= 2
    begins, stops, starts, ends, owner = begins[there], stops[there], starts[there], ends[there], owner[there]
    return span_hash(low, starts, ends), owner, place[starts], place[ends], place[begins], place[stops], starts, ends


def char_places(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte of UTF-8, and in all."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def outside(begins: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether words overlap none of the (start, end) spans, which are ordered by start."""
    if not spans:
        return np.ones(len(begins), dtype=bool)
    start, end = np.array(spans).T
    before = np.searchsorted(start, stops, side="left")
    return np.concatenate(([-1], np.maximum.accumulate(end)))[before] <= begins


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every document, its entities, and where it has any the distinct terms outside of base spans."""
    schema = "doc_id long, row long, base array<struct<start:int,kind:int,end:int>>, entities array<long>, terms array<long>"
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def kernel(batch):
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            base, entities, terms = [], [], []
            for text in part.column(2).to_pylist():
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in spans])
                held = {ANY} if spans else set()
                held |= {KINDS[k] for _, k, _, _ in spans} | {f"{KINDS[k]}:{v}" for _, k, _, v in spans}
                entities.append(sorted(map(_hash, held)))
                if spans:
                    raw = np.frombuffer(text.encode(), dtype=np.uint8)
                    h, _, _, _, begins, stops, *_ = terms_of(raw, np.array([0, len(raw)]))
                    terms.append(signed(np.unique(h[outside(begins, stops, [(s, e) for s, _, e, _ in spans])])))
                else:
                    terms.append([])
            yield pa.record_batch([part.column(0), part.column(1), pa.array(base, type=base_type), pa.array(entities, type=pa.list_(pa.int64())), pa.array(terms, type=pa.list_(pa.int64()))], names=["doc_id", "row", "base", "entities", "terms"])

    return on_batches(docs, ["doc_id", "row", "text"], kernel, schema)


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, docs): documents that hold a word, over all documents; counted per task first."""

    def run(batches):
        held = []

        def flush():
            keys, count = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            unique, which = np.unique(keys, return_inverse=True)
            return unique, np.bincount(which, weights=count).astype(np.int64)

        size = 0
        for batch in batches:
            for _, _, data, offsets in per_slice(batch.column(0)):
                keys, owner, *_ = terms_of(data, offsets)
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                if not len(keys):
                    continue
                new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
                keys = keys[new]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                size += len(first)
                if size > 3_000_000:
                    held[:] = [flush()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield pa.record_batch([pa.array(signed(held[0][0])), pa.array(held[0][1])], names=["term", "docs"])
                        held.clear()
                        size = 0
        if held:
            keys, count = flush()
            yield pa.record_batch([pa.array(signed(keys)), pa.array(count)], names=["term", "docs"])

    counted = docs.select("text").mapInArrow(run, "term long, docs long")
    return counted.groupBy("term").agg(F.sum("docs").alias("docs"))


def joined_spans(spans):
    """kind:start:end, comma-joined, of an array of (start, kind, end) structs in order."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def byte_pairs(docs: DataFrame) -> np.ndarray:
    """Bits of each byte after each other one, (256, 256), from the bigrams of all texts."""

    def run(batches):
        count = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for _, _, data, _ in per_slice(batch.column(0)):
                count += np.bincount(data[:-1].astype(np.int64) * 256 + data[1:], minlength=1 << 16) if len(data) else 0
        at = np.flatnonzero(count)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["pair", "n"])

    found = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most 65,536 rows
    count = np.ones(1 << 16)
    count[found["pair"].to_numpy()] += found["n"].to_numpy()
    count = count.reshape(256, 256)
    return -np.log2(count / count.sum(axis=1, keepdims=True))


def self_telling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which words data[starts:ends] are identifiers: letters and digits, and SELF_BITS at least."""
    flat = np.concatenate(([0.0], np.cumsum(bits[data[:-1], data[1:]]))) if len(data) else np.zeros(1)
    digits, letters = (np.concatenate(([0], np.cumsum(m))) for m in ((data >= 0x30) & (data <= 0x39), ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)))
    told = flat[np.maximum(ends - 1, starts)] - flat[starts]
    return (ends - starts >= SELF_LENGTH) & (told >= SELF_BITS) & (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])


def _once(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): each doc_id and text once; row is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    if rows.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        return rows
    return rows.dropDuplicates(["doc_id", "row"])


def find_pii(docs: DataFrame, work: Work, **thresholds) -> DataFrame:
    """doc_id, row (hash of the text), base and terms, arrays of spans, for each doc_id and text; a term's `removed`
    says how it is treated. The table outlives `work`."""
    once = _once(docs)
    found = work.save(scan(once), "scan")
    telling = work.save(telling_terms(once, found, work, **thresholds), "telling")
    span = F.struct("start", F.lit(4).alias("kind"), "end", "removed")
    words = work.save(places(once, telling, byte_pairs(once)), "words")
    named = words.where("term is not null").join(telling, "term").unionByName(words.where("term is null").withColumn("removed", F.lit(True)))
    terms = named.groupBy("doc_id", "row", "start", "end").agg(F.max("removed").alias("removed")).groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(span)).alias("terms")).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "terms")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")
    out = found.drop("terms").join(terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    return work.keep(out.select("doc_id", "row", "base", F.coalesce("terms", none).alias("terms")), "pii")


def telling_terms(once: DataFrame, found: DataFrame, work: Work, min_support: int = MIN_SUPPORT, disclose: float = DISCLOSE, remove: float = REMOVE, min_bits: float = MIN_BITS, margin: float = MARGIN) -> DataFrame:
    """(term, removed): the terms that give anything protected away."""
    holds = found.where(F.size("entities") > 0).select("terms", F.explode("entities").alias("entity"))
    of_entity = work.save(holds.groupBy("entity").agg(F.count("*").alias("entity_docs")).where(F.col("entity_docs") >= min_support), "entities")
    together = holds.join(of_entity, "entity").select("entity", F.explode("terms").alias("term"))
    pairs = together.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= min_support)
    docs = work.save(document_frequency(once), "frequency")
    total, kinds = found.count(), docs.count()
    given = F.col("both") / F.greatest("docs", "both")
    bits = F.log2(given / (F.col("entity_docs") / F.lit(max(total, 1))))
    chance = float(np.log2(max(kinds, 1)) + margin)
    telling = pairs.join(docs, "term").where(given >= disclose).join(of_entity, "entity").where((bits >= min_bits) & (bits * F.col("both") >= chance))
    return telling.groupBy("term").agg(F.max(given >= remove).alias("removed"))


def places(once: DataFrame, telling: DataFrame, pair_bits: np.ndarray, log_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, row, term, start, end) of the words of all texts, outside of base spans, that may be telling: all that
    are, and some whose hash shares a bit with one; term is null for identifiers. The filter has 2**log_bits bits,
    whatever the number of terms."""
    bit = F.col("term").bitwiseAND((1 << log_bits) - 1)
    words = telling.groupBy(F.shiftright(bit, 5).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(term & 31 as int)))").alias("bits")).toArrow()  # at most 2**log_bits / 32 rows
    table = np.zeros(1 << (log_bits - 5), dtype=np.uint32)
    table[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)

    def kernel(batch):
        for i, j, data, offsets in per_slice(batch.column(2)):
            h, owner, starts, ends, begins, stops, first, last = terms_of(data, offsets)
            own = self_telling(data, first, last, pair_bits)
            slot = h & np.uint64((1 << log_bits) - 1)
            hit = np.flatnonzero(own | ((table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1)) > 0))
            if not len(hit):
                continue
            shift = char_places(data)[offsets]
            keep = np.ones(len(hit), dtype=bool)
            texts = owner[hit]
            for lo, hi in zip(edge := np.flatnonzero(np.diff(texts, prepend=-1)), [*edge[1:], len(texts)], strict=True):
                at, k = hit[lo:hi], texts[lo]
                spans = [(s, e) for s, _, e, _ in base_spans(batch.column(2)[i + int(k)].as_py())]
                keep[lo:hi] = outside(begins[at] - shift[k], stops[at] - shift[k], spans)
            hit, texts = hit[keep], texts[keep]
            for lo in range(0, len(hit), 100_000):
                at, k = hit[lo : lo + 100_000], texts[lo : lo + 100_000]
                rows = pa.array(i + k)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(signed(h[at]), mask=own[at]), pa.array((starts[at] - shift[k]).astype(np.int32)), pa.array((ends[at] - shift[k]).astype(np.int32))], names=["doc_id", "row", "term", "start", "end"])

    return on_batches(once, ["doc_id", "row", "text"], kernel, "doc_id long, row long, term long, start int, end int")


def _is_kind(k: int):
    return lambda s: s["kind"] == k  # a second parameter would be the index


def span_report(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, n_spans, base_sha256, spans for every row."""
    with Work(docs.sparkSession, "pii") as work:
        found = find_pii(docs, work, **thresholds)
        plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        merged = F.sort_array(F.concat("base", plain))
        n = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
        size = (F.size("base") + F.size("terms")).cast("long").alias("n_spans")
        report = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), *n, F.size("terms").cast("long").alias("n_term"), size, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(merged).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    return rows.join(report, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).drop("d", "r", "row")


def replaced(text: str, spans: list[dict]) -> str:
    """The text with its spans, in order of start, replaced; what overlaps an earlier span is part of it."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], s["by"]]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents with base spans replaced by [KIND], generalised terms by [TERM], removed terms by nothing."""
    taken = {c.lower() for c in docs.columns}
    free = lambda name, *ends: next(n for k in range(len(taken) + 1) if not {(n := name + "_" * k) + e for e in ("", *ends)} & taken)
    spans, key = free("spans"), free("row", "d", "r")
    with Work(docs.sparkSession, "sanitise") as work:
        found = find_pii(docs, work, **thresholds).where((F.size("base") > 0) | (F.size("terms") > 0))
        bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1).alias("by")))
        term = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], "").otherwise("[TERM]").alias("by")))
        found = found.select(F.col("doc_id").alias(f"{key}d"), F.col("row").alias(f"{key}r"), F.sort_array(F.concat(bare, term)).alias(spans))
    hashed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = hashed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{key}d")) & (F.col(key) == F.col(f"{key}r")), "left").select(*docs.columns, spans)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column, found = batch.column(place), batch.column(len(batch.columns) - 1)
            with_spans = found.is_valid()
            rows = np.flatnonzero(with_spans.to_numpy(zero_copy_only=False))
            columns = list(batch.columns[:-1])
            if len(rows):
                new = [replaced(column[k].as_py(), found[k].as_py()) for k in rows.tolist()]
                columns[place] = pc.replace_with_mask(column, with_spans, pa.array(new, type=column.type))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
