"""Chunking in Catalyst against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.functions import chunking as C
from mnemora.operators import ingestion as I


def atoms(text, most):
    if len(text) <= most:
        return [text]
    for mark in ("\n\n", "\n", ". ", " "):
        parts = [p for p in text.split(mark) if p]
        if len(parts) > 1:
            return [a for p in parts for a in atoms(p, most)]
    return [text[i : i + most] for i in range(0, len(text), most)]


def text_chunks(text, target, most):
    text = text.strip(" \t\n\x0b\f\r")
    if len(text) <= target:
        return [text] if text else []
    out = []
    for atom in atoms(text, most):
        if out and len(out[-1]) + 1 + len(atom) <= target:
            out[-1] += "\n" + atom
        else:
            out.append(atom)
    return out


def packed_turns(turns, most):
    whole = "\n".join(turns)
    if len(whole) <= most:
        return [whole]
    out, current = [], None
    for turn in turns:
        if len(turn) > most:
            out += ([current] if current is not None else []) + atoms(turn, most)
            current = None
        elif current is not None and len(current) + 1 + len(turn) <= most:
            current += "\n" + turn
        else:
            out += [current] if current is not None else []
            current = turn
    return out + ([current] if current is not None else [])


def made(rng):
    return "".join(rng.choice(["\n\n", "\n", ". ", " ", "word", "é😀", "x" * rng.randrange(40), "a.b", "$1\\"]) for _ in range(rng.randrange(80)))


@pytest.mark.parametrize("target,most", [(20, 40), (50, 17), (100, 100)])
def test_texts(spark, target, most):
    rng = random.Random(target)
    texts = [made(rng) for _ in range(150)] + ["", "  \n", "x" * 500, "\n\n" + "y" * 99, ". " * 60, "a" * target, "word " * 30_000]
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "source_id long, content string").repartition(3)
    got = {}
    for r in I.chunk_text(df, target, most).orderBy("source_id", "sequence").collect():
        assert r.sequence == len(got.setdefault(r.source_id, []))
        got[r.source_id].append(r.content)
    assert got == {i: c for i, t in enumerate(texts) if (c := text_chunks(t, target, most))}


def test_turns(spark):
    rng = random.Random(3)
    rows = [[made(rng) or "t" for _ in range(rng.randint(1, 6))] for _ in range(150)] + [["a", "b"], ["aaaa", "bbbb", "cccccccccccc", "d"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, turns array<string>")
    for most in (9, 60):
        got = {r.i: r.p for r in df.select("i", C.packed_turns(F.col("turns"), most).alias("p")).collect()}
        assert got == {i: packed_turns(t, most) for i, t in enumerate(rows)}
    assert packed_turns(rows[-1], 9) == ["aaaa\nbbbb", "ccccccccc", "ccc", "d"]


def test_no_python_and_unknown_types(spark):
    df = spark.createDataFrame([(1, "a\x00b", "Text", None), (2, "x", "pdf", None), (3, "x", None, None), (4, "x", "PDF", "s")], "source_id long, content string, content_type string, session_id string")
    out = I.chunk_sources(df)
    assert {(r.source_id, r.content) for r in out.collect()} == {(1, "ab"), (3, "x")}
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert {(r.source_id, r.reason) for r in I.unsupported(df).collect()} == {(2, "unsupported content type: pdf"), (4, "unsupported content type: PDF")}
