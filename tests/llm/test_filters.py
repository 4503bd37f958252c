"""The filter audit against documents that go through every order one by one."""

import random
import re
from collections import Counter
from itertools import permutations

from mnemora.llm.filters import filter_audit

DOCS = "doc_id long, text string, lang string, mask long, part string, digest string, good long"


def some_documents(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 5, 199, 200, 250, 400])
        words = [f"w{rng.randrange(rng.choice([3, 40, 4000]))}" for _ in range(n)]
        words = [w.upper() if rng.random() < rng.choice([0, 0.3]) else w for w in words]
        sep = rng.choice([" ", "\n", "\t", "\x0b", "  "])
        rows.append((i, rng.choice(["", " "]) + sep.join(words) + rng.choice(["", " $", "&", "|", " É"]), rng.choice(["en", "fr", None, ""])))
    rows += [(1000 + i, rows[rng.randrange(40)][1], rng.choice(["en", "de"])) for i in range(40)]
    rows += [(i, None, "en") for i in (500, 501)] + [(None, rows[0][1], "en"), (None, "new", None), (7, rows[7][1], "en"), (7, "other $", "en")]
    rows.append((600, "long " * 30_000 + "# end", "en"))
    rng.shuffle(rows)
    return rows


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    want = {}
    for part in {lang or "" for _, _, lang in rows}:
        docs = []
        for d, text, lang in rows:
            if (lang or "") != part:
                continue
            text = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            fails = {
                "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and least[text] < d,
            }
            docs.append((d, {k for k, v in fails.items() if v}))
        removed_by = Counter()
        for order in permutations("ABCDE"):
            here = list(docs)
            for step, letter in enumerate(order, 1):
                out = [x for x in here if letter in x[1]]
                here = [x for x in here if letter not in x[1]]
                removed_by[letter] += len(out)
                failing = sum(letter in f for _, f in docs)
                want[part, "".join(order), step] = [len(here), len(out), failing - len(out), sum(f == {letter} for _, f in docs), sum(d in good for d, _ in out), sum(d in toxic for d, _ in out)]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return want


def test_every_order(spark):
    rows = some_documents()
    rng = random.Random(5)
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d in range(0, 1050, 2)] + [(4, 1, None), (6, None, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOCS).repartition(5)
    out = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out.collect()}
    assert got == plain(rows, labels)
    assert any(r[6] for r in got.values()) and any(r[4] for r in got.values())


def test_shares_sum_to_what_all_remove(spark):
    rows = some_documents(8)
    out = filter_audit(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    n = Counter(lang or "" for _, _, lang in rows)
    for r in out.where("filter_order = 'ABCDE'").groupBy("part").agg({"shapley": "sum", "removed": "sum"}).collect():
        assert r["sum(shapley)"] == 120 * r["sum(removed)"] <= 120 * n[r.part]


def test_empty(spark):
    assert filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
