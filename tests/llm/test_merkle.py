"""The manifest against a tree built in plain code."""

import hashlib
import random
import zlib

import pytest

from mnemora.llm.merkle import dataset_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, digest string, index long, size long, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    return sha("".join(map(cell, row)))


def climb(level, i):
    """(siblings of each run up to the top, top) from place i."""
    path = []
    while len(level) > 1:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        path.append((run[: i % 8], run[i % 8 + 1 :]))
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        i //= 8
    return path, level[0]


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    keys = sorted(groups, key=str.encode)
    leaves = {}
    for g in keys:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        leaves[g] = [leaf_of(r) for r in groups[g]]
    subroots = [climb(leaves[g], 0)[1] for g in keys]
    out = []
    for k, g in enumerate(keys):
        for i, r in enumerate(groups[g]):
            path, subroot = climb(leaves[g], i)
            upper, root = climb(subroots, k)
            path += upper
            held = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                held = (*r[:4], r[4].translate(low))
            acc = leaf_of(held)
            for left, right in path:
                acc = sha("".join(left) + acc + "".join(right))
            out.append((r[0], leaf_of(r), subroot, root, sha("".join("".join(a) + "".join(b) for a, b in path)), acc, acc == root))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "g", "d", 1, 2, "p") for r in rows], DOCS).repartition(5)


def got(spark, rows):
    out = dataset_manifest(made(spark, rows))
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_groups_of_all_sizes(spark):
    rng = random.Random(2)
    rows = []
    for lang, n in (("en", 530), ("fr", 64), ("de", 65), ("es", 9), (None, 8), ("", 1), ("é", 2), ("z", 7)):
        rows += [(rng.randrange(10**6), rng.choice(["s1", "Quelle", None]), lang, rng.choice([None, 5]), rng.choice(["A b", "ÀB", "", None, "x" * 300, "lower"])) for _ in range(n)]
    rows += [(None, "s", "en", 1, "T"), (None, "s", "en", 1, "U"), (5, "s", "en", 1, "same"), (5, "s", "en", 1, "same"), (5, "t", "en", 1, "Other"), (6, None, None, None, None), (8, "s", "fr", 2, "L" * 400_000)]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[(3, "s", "en", 1, "ONE")], [(3, "s", "en", 1, "one"), (4, "s", "fr", 1, "two")], [(i, None, None, None, None) for i in range(9)], [(k, "s", str(k), 1, "T") for k in range(70)]])
def test_small_trees(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_empty(spark):
    assert dataset_manifest(made(spark, [])).count() == 0
