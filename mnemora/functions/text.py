"""Text expressions of the memory engine, as Columns; all stay inside Catalyst.

`\\w` and `\\s` are ASCII here, so accented letters split words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that never become tokens
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could "
    "of in on at to for with by from and or but not no nor so yet both either neither each every all any few more most "
    "other some such than too very just also about above after again against am as because before below between during "
    "here how i if into it its me my myself now only out over own same she he they them their there these this those "
    "through under until up we what when where which while who whom why you your"
).split()

# fixed values: patterns that tell the current-value and update wording
CURRENT_QUERY = r"(?i)\b(current|currently|latest|now|most recent|still|today)\b"
UPDATE_MEMORY = r"(?i)\b(changed?|correct(?:ed|s)?|no longer|now|replac(?:ed|es)|remain(?:s|ed)|still|instead|updat(?:ed|es?))\b"
STILL_QUERY = r"(?i)^(?:am|are|can|could|did|do|does|has|have|is|was|were|will|would)\b.*\bstill\b"
REVISED, UNREVISED = 0.15, -0.25

# fixed values: intents in order of precedence, with their confidence
INTENTS = [
    ("PREFERENCE", 0.9, [
        r"\b(prefer|preference|preferences|favorite|favourite)\b",
        r"\b(what do i like|what do i love|what do i hate|what do i dislike)\b",
        r"\b(my (?:favorite|favourite|preferred|liked|disliked|hated|loved|preferences))\b",
        r"\b(what kind of .+ (?:do i|i like|i prefer))\b",
    ]),
    ("PERSONAL", 0.85, [
        r"\b(my|me|mine|i|myself)\b",
        r"\b(do you remember|you know|you recall)\b",
        r"\b(what am i|who am i|where do i|where did i|what do i|what did i|what have i)\b",
        r"\b(tell me about myself|about me)\b",
    ]),
    ("ENTITY_LOOKUP", 0.8, [
        r"\b(who is|who was|who are|who were)\b",
        r"\b(whose .+ (?:is|are|was|were))\b",
        r"\b(where does .+ work|where do .+ work|where did .+ work)\b",
        r"\b(where is .+ (?:from|located|based))\b",
        r"\b(what does .+ do|what do .+ do)\b",
        r"\b(tell me about .+)\b.{0,10}$",
    ]),
]

# fixed values: queries that only look as if they named a time
NON_TEMPORAL = [
    r"\bcurrent version\b",
    r"\bcurrent code\b",
    r"\bcurrent directory\b",
    r"\bcurrent working\b",
    r"\bcurrent (file|project|repo|repository|branch|folder|path)\b",
    r"\bhow (to|do|can|does|should)\b(?!.+\b(i|me|my|mine|myself|we|us|our|ours|user)\b)",
    r"\bexplain\b(?!.+\b(i|me|my|mine|myself|we|us|our|ours|user)\b)",
    r"\bdefine\b(?!.+\b(i|me|my|mine|myself|we|us|our|ours|user)\b)",
]

MAX_TERMS, MAX_TERM_LENGTH = 96, 64


def any_of(c: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def collapse(c: Column) -> Column:
    """One blank between words, none around them."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def collapse_lower(c: Column) -> Column:
    return F.lower(collapse(c))


casefold = collapse_lower


def word_count(c: Column) -> Column:
    return F.when(collapse(c) == "", 0).otherwise(F.size(F.split(collapse(c), " "))).cast("long")


def tokenize(c: Column) -> Column:
    """Distinct lower-case words of two characters or more that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))


def bounded_terms(c: Column, most: int = MAX_TERMS, length: int = MAX_TERM_LENGTH) -> Column:
    """The first `most` words of a query that aren't longer than `length`."""
    words = F.filter(F.split(collapse(c), " "), lambda w: (F.length(w) > 0) & (F.length(w) <= length))
    return F.slice(words, 1, most)


def relation_name(c: Column) -> Column:
    """WORDS_JOINED_BY_UNDERSCORES."""
    joined = F.regexp_replace(collapse(F.translate(c, "-", "_")), " ", "_")
    return F.regexp_replace(F.upper(joined), "_+", "_")


def slug(c: Column, suffix: Column | None = None, trim: bool = True, most: int = 58) -> Column:
    out = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    if trim:
        out = F.regexp_replace(out, "^-+|-+$", "")
    out = F.substring(out, 1, most)
    return out if suffix is None else F.concat_ws("-", out, suffix)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def format_messages(turns: Column) -> Column:
    """`role: content` lines of an array of (turn, role, text) structs, in order of turn."""
    return F.array_join(F.transform(F.sort_array(turns), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def dated_document(content: Column, event: Column, recorded: Column | None = None) -> Column:
    """The text given to a reranker, with its dates in front."""
    shown = lambda t: F.date_format(t, "MMMM dd, yyyy (yyyy-MM-dd)")
    parts = [F.when(event.isNotNull(), F.concat(F.lit("[Date: "), shown(event), F.lit("]")))]
    if recorded is not None:
        parts.append(F.when(recorded.isNotNull(), F.concat(F.lit("[Recorded: "), shown(recorded), F.lit("]"))))
    return F.concat_ws(" ", *parts, content)


def enriched(content: Column, event: Column) -> Column:
    """The text to embed: with the month it happened in."""
    return F.concat(content, F.when(event.isNotNull(), F.concat(F.lit(" (happened in "), F.date_format(event, "MMMM yyyy"), F.lit(")"))).otherwise(""))


def escape_tags(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def matches_all(c: Column, required: Column, banned: Column | None = None) -> Column:
    """Whether all required substrings occur, lower-cased, and none of the banned ones."""
    low = F.lower(c)
    ok = F.forall(required, lambda p: F.contains(low, F.lower(p)))
    return ok if banned is None else ok & ~F.exists(F.coalesce(banned, F.array().cast("array<string>")), lambda p: F.contains(low, F.lower(p)))


def intent(c: Column) -> Column:
    """(name, confidence) of a query; FACTUAL where no pattern fits."""
    low = collapse_lower(c)
    pick = lambda value: F.struct(F.lit(value[0]).alias("name"), F.lit(value[1]).alias("confidence"))
    out = None
    for name, confidence, patterns in INTENTS:
        test = any_of(low, patterns)
        out = F.when(test, pick((name, confidence))) if out is None else out.when(test, pick((name, confidence)))
    return out.otherwise(pick(("FACTUAL", 0.0)))


def names_no_time(c: Column) -> Column:
    return any_of(collapse_lower(c), NON_TEMPORAL)


def uses_recorded_time(query: Column, content: Column) -> Column:
    return query.rlike(CURRENT_QUERY) & content.rlike(UPDATE_MEMORY)


def revision_adjustment(query: Column, content: Column) -> Column:
    return F.when(query.rlike(STILL_QUERY), F.when(content.rlike(UPDATE_MEMORY), REVISED).otherwise(UNREVISED)).otherwise(0.0)


def without_nul(c: Column) -> Column:
    return F.regexp_replace(c, "\\x00", "")


def encode_cursor(at: Column, key: Column) -> Column:
    """An opaque page cursor: URL-safe base64 without padding."""
    raw = F.base64(F.concat_ws("|", at.cast("string"), key.cast("string")).cast("binary"))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), "[=\\s]", "")


def decode_cursor(c: Column) -> Column:
    """(at, key) strings of a cursor; null where it is none."""
    plain = F.translate(c, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))
    parts = F.split(F.try_to_binary(padded, F.lit("base64")).cast("string"), r"\|")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("at"), parts[1].alias("key")))


def content_key(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)
