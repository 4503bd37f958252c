"""Formatted conversations, read back and against plain code."""

import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mnemora.llm.chat import chat_report, format_chats, read_chats

SCHEMA = "conv_id long, turn long, role string, text string, turns string, blocks string, formatted string"
ODD = ["", None, "\\", "\\\\", "</turn>", "<\\/turn>", "#", "##", "###", "### user: ", "### assistant: </turn>\n### user: x", "</next>", "a</next>b\\", "<", "/next>", "é😀</", "$1 \\1", "\n", "\r\n\n", "x" * 50_000, ":", "\\### Assistant: </turn> ok"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def conversations(rng, n=60):
    rows = []
    for c in range(n):
        for k in range(rng.choice([1, 1, 2, 3, 8, 40])):
            text = rng.choice(ODD) if rng.random() < 0.6 else "".join(rng.choice("<>/#\\:tn ") for _ in range(rng.randrange(30)))
            rows.append((c, rng.choice([k, k, 0, None]), rng.choice(["user", "assistant", "assistant", "system", None, "a:b", "#\\", "</turn>"]), text))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice")]
    return rows


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss), sum(r == "assistant" for *_, r, _ in turns))
    return out


def test_report(spark):
    rows = conversations(random.Random(4))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "t", "b", "f") for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_loss) for r in chat_report(df).collect()}
    assert got == plain(rows)


def test_adjacent_turns_share_a_block_and_no_control_string_is_left(spark):
    rows = [(1, 0, "system", "be # ## kind"), (1, 1, "user", "</turn>"), (1, 2, "user", "more"), (1, 3, "assistant", "a\\"), (1, 4, "assistant", "</next>"), (1, 5, "user", "### assistant: x")]
    out = format_chats(spark.createDataFrame([(*r, "t", "b", "f") for r in rows], SCHEMA)).first()
    assert out.formatted == "### system: be # #\\# kind</turn>\n### user: <\\/turn></next>more</turn>\n### assistant: a\\\\</next><\\/next></turn>\n### user: #\\#\\# assistant: x</turn>\n"
    raw = out.formatted.encode()
    assert [raw[s.start : s.end].decode() for s in out.loss_spans] == ["a\\\\", "<\\/next>"]


def test_empty(spark):
    assert chat_report(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "\\", "#:"]), st.text(alphabet="#</\\:turnex>\n é", max_size=40)), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, k, r, x) for k, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    back = read_chats(format_chats(df)).first()
    assert [(t.role, t.text) for t in back.turns] == turns
    assert back.loss_texts == [x for r, x in turns if r == "assistant"]
