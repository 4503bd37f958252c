"""Conversations as training texts with a loss mask, by Spark expressions alone, and read back from them.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into a block:

    ### role: text</next>text</turn>

Texts and roles are escaped so that no control string is left in them: every backslash is doubled, and one is
put into `</`, between two `#` and, in roles, before `:`. A backslash thus always quotes the character behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
HEAD, COLON, NEXT, END = "### ", ": ", "</next>", "</turn>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once a row; inside a lambda Spark may compute a column again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</"), F.lit("<\\/"))
    return F.regexp_replace(text, "#(?=#)", r"#\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def merged(turns: Column) -> Column:
    """Blocks of (role, first, n): the runs of adjacent turns of one role, by their places in the array."""
    none = F.array().cast("array<struct<role:string,first:int,n:int>>")

    def take(blocks, place):
        turn, last = F.get(turns, place), F.try_element_at(blocks, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), last["first"].alias("first"), (last["n"] + 1).alias("n"))
        new = F.struct(turn["role"].alias("role"), (place + 1).alias("first"), F.lit(1).alias("n"))
        joins = (F.size(blocks) > 0) & (last["role"] == turn["role"])
        return F.when(joins, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(F.sequence(F.lit(0), F.size(turns) - 1), none, take)


def format_chats(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation's text and what of it is trained on.

    Turns are ordered by turn (null first), then role and text, so ties have a defined order and repeated rows are
    turns of their own. Null texts and roles count as empty; a null conv_id is a conversation like any other. Empty
    texts of the trained role have an empty span. A loss span is (start, end) in bytes of the UTF-8 text, end exclusive,
    one for each turn of the trained role. A conversation is a row of the result, so it must fit one: 2 GB. An empty
    table gives no rows. Extra columns are not read.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.sort_array(F.collect_list(turn))
    rows = conversations.groupBy("conv_id").agg(sorted_turns.alias("turns"))

    def block(b, texts):
        head = F.concat(F.lit(HEAD), escaped_role(b["role"]), F.lit(COLON))
        return F.struct((b["role"] == trained).alias("trained"), head.alias("head"), F.slice(texts, b["first"], b["n"]).alias("texts"))

    def blocks_of(turns):
        texts = F.transform(turns, lambda t: escaped(t["text"]))
        return bound(texts, lambda x: F.transform(merged(turns), lambda b: block(b, x)))

    rows = rows.select("conv_id", bound(F.col("turns"), blocks_of).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], NEXT), F.lit(END))), "")
    # what stands before, within and behind each text, in bytes
    piece = lambda b, t, i: F.struct(F.when(i == 0, F.octet_length(b["head"])).otherwise(len(NEXT)).alias("before"), F.octet_length(t).alias("own"), F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("behind"), b["trained"].alias("trained"))
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: piece(b, t, i))))
    rows = rows.select("conv_id", text.alias("formatted"), pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def span(s, p):
        at = s["at"] + p["before"]
        found = F.struct(at.alias("start"), (at + p["own"]).alias("end"))
        return F.struct((at + p["own"] + p["behind"]).alias("at"), F.when(p["trained"], F.concat(s["spans"], F.array(found))).otherwise(s["spans"]).alias("spans"))

    return rows.select("conv_id", "formatted", F.aggregate("pieces", start, span, lambda s: s["spans"]).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) of formatted conversations: the turns by the template, the trained texts by the spans."""
    blocks = F.filter(F.split("formatted", END), lambda b: b != "")
    parted = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, rf"(?s)^{HEAD}((?:[^:\\]|\\.)*){COLON}", 1).alias("role"), b.alias("block")))
    turns = F.flatten(
        F.transform(
            parted,
            lambda b: F.transform(F.split(F.substr(b["block"], F.length(b["role"]) + len(HEAD) + len(COLON) + 1), F.lit(NEXT)), lambda t: F.struct(unescaped(b["role"]).alias("role"), unescaped(t).alias("text"))),
        )
    )
    cut = lambda raw: F.transform("loss_spans", lambda s: unescaped(F.decode(F.substring(raw, s["start"] + 1, s["end"] - s["start"]), "utf-8")))
    losses = bound(F.encode("formatted", "utf-8"), cut)
    return formatted.select("conv_id", turns.alias("turns"), losses.alias("loss_texts"))


def chat_report(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_loss): what is read back from the
    formatted conversations."""
    out = format_chats(conversations, trained)
    back = read_chats(out.withColumn("conv_id", F.struct("conv_id", F.length("formatted").alias("n"))))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.array_join("loss_texts", "").alias("loss"), F.size("loss_texts").cast("long").alias("n_loss"))
    return rows.select(F.col("conv_id.conv_id").alias("conv_id"), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("conv_id.n").cast("long").alias("formatted_chars"), "n_loss")
