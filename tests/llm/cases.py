"""Documents of all odd kinds, and helpers."""

import random

WORDS = [f"w{i}" for i in range(40)] + ["Émile", "naïve", "über", "the", "of"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, component_id string"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(spark, seed=1, n=60, odd=True):
    """Near and exact copies, nulls, empties, a long text, repeated rows, and columns with clashing names."""
    rng = random.Random(seed)
    base = [text(rng, rng.randint(20, 90)) for _ in range(n // 3)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n // 3):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, rng.choice(base)) for i in range(n // 6)]
    if odd:
        rows += [(300, None), (301, ""), (302, "   \n\t"), (303, "one"), (304, "one"), (305, "two words"), (306, "a b c d"), (307, "A B C D"), (308, text(rng, 4000))]
        rows += [(309, base[0].upper()), (310, base[1] + "\n" + base[2]), (311, "é" * 300), (312, "x" * 5000)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "u", "c") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


class Groups:
    """Components over any keys, by the smallest key."""

    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, k):
        while self.up[k] != k:
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
