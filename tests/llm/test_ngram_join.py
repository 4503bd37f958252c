import itertools
import re

import pytest

from mnemora.llm.ngram_join import ngram_jaccard_join
from tests.llm.cases import SCHEMA, Groups, documents, empty, rows_of, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(docs):
    sets = {k: shingles(t) for k, t in docs.items()}
    groups = Groups(sets)
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            groups.join(a, b)
    return sorted((k, len(s), groups.find(k)) for k, s in sets.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = documents(spark, seed, 120)
    want = brute(texts(docs))
    assert rows_of(ngram_jaccard_join(docs), "doc_id", "n_shingles", "component_id") == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_chain_of_near_copies(spark):
    """Neighbours of a chain link, its ends don't: all are one component."""
    rows = [(i, " ".join(f"t{k}" for k in range(4 * i, 4 * i + 60))) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "", "") for i, t in rows], SCHEMA)
    want = brute(dict(rows))
    assert rows_of(ngram_jaccard_join(docs), "doc_id", "n_shingles", "component_id") == want
    assert {c for _, _, c in want} == {0}


def test_no_rows_and_repeats(spark):
    assert ngram_jaccard_join(empty(spark)).count() == 0
    docs = documents(spark, 3, 30)
    twice = docs.union(docs.where("doc_id < 5"))
    got = rows_of(ngram_jaccard_join(twice), "doc_id", "component_id")
    assert len(got) == twice.count()
    assert set(got) == {(k, c) for k, _, c in brute(texts(docs))}


def test_null_doc_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "", "", 0, "", ""), (4, "a b c d e f", "", "", 0, "", ""), (5, None, "", "", 0, "", "")], SCHEMA)
    got = {(r.doc_id, r.n_shingles) for r in ngram_jaccard_join(docs).collect()}
    assert got == {(None, 2), (4, 2), (5, 0)}
