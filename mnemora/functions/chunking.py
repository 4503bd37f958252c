"""Texts cut into pieces of bounded length, as Catalyst expressions: unrolled separators, and folds that pack."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: separators from coarse to fine
MARKS = ("\n\n", "\n", ". ", " ")
STRINGS = "array<string>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, wherever `use` puts it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(mark: str, most: int) -> Callable[[Column], Column]:
    """What parts a piece that is too long at one separator, if it does so."""

    def parted(a: Column) -> Column:
        parts = F.filter(F.split(a, re.escape(mark)), lambda p: p != "")
        return F.when(F.length(a) <= most, F.array(a)).otherwise(once(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(a))))

    return parted


def atoms(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters, each cut at the coarsest separator that parts it; else after `most` characters."""
    out = F.array(text)
    for mark in MARKS:
        out = F.flatten(F.transform(out, _at(mark, most)))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.length(a) / most).cast("int") - 1), lambda i: F.substring(a, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(out, lambda a: F.when(F.length(a) <= most, F.array(a)).otherwise(cut(a))))


_STATE = "struct<done:array<string>,open:string>"


def _state(done: Column, open_: Column) -> Column:
    return F.struct(done.alias("done"), open_.cast("string").alias("open")).cast(_STATE)


def _closed(s: Column) -> Column:
    """All pieces, the open one included."""
    return F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))


def _taken(s: Column, piece: Column, most: int) -> Column:
    """The state after a piece that joins the open one if both fit, else begins a new one."""
    fits = s["open"].isNotNull() & (F.length(s["open"]) + 1 + F.length(piece) <= most)
    return F.when(fits, _state(s["done"], F.concat(s["open"], F.lit("\n"), piece))).otherwise(_state(_closed(s), piece))


def text_pieces(text: Column, target: int, most: int) -> Column:
    """A text's atoms joined by newlines up to `target` characters."""
    empty = _state(F.array().cast(STRINGS), F.lit(None))
    packed = F.aggregate(atoms(text, most), empty, lambda s, a: _taken(s, a, target), _closed)
    return F.when(text == "", F.array().cast(STRINGS)).when(F.length(text) <= target, F.array(text)).otherwise(packed)


def packed_turns(turns: Column, most: int) -> Column:
    """A segment's turns joined by newlines in pieces of at most `most` characters; a longer turn is cut by itself."""
    empty = _state(F.array().cast(STRINGS), F.lit(None))

    def take(s, t):
        alone = _state(F.concat(_closed(s), atoms(t, most)), F.lit(None))
        return F.when(F.length(t) > most, alone).otherwise(_taken(s, t, most))

    whole = F.array_join(turns, "\n")
    return F.when(F.length(whole) <= most, F.array(whole)).otherwise(F.aggregate(turns, empty, take, _closed))
