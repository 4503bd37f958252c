import numpy as np

from mnemora.llm import quality
from mnemora.llm.quality import FEATURES, classify_quality
from tests.llm.cases import documents, empty

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = classify_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 500
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = documents(spark, 13, 60)
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = [r.doc_id for r in docs.collect()]
    a = spark.createDataFrame([(i, i % 2, 0) for i in ids], LABELS)
    b = spark.createDataFrame([(i, (i + held(i)) % 2, 1) for i in ids], LABELS)
    rows = lambda x: sorted(map(tuple, classify_quality(docs, x).collect()))
    assert rows(a) == rows(b)
    assert all(r[1] == held(r[0]) for r in rows(a))


def test_no_labels_or_rows(spark):
    docs = documents(spark, 14, 30)
    none = spark.createDataFrame([], LABELS)
    assert classify_quality(empty(spark), none).count() == 0
    scores = {r.score for r in classify_quality(docs, none).collect()}
    assert scores == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(3, None, 0), (None, 0, 0), (4, 1, 1)], LABELS)
    assert len({r.score for r in classify_quality(docs, ones).collect()}) == 1


def test_trees_learn_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(FEATURES)))
    y = ((x[:, 3] > 0.4) & (x[:, 7] < 0.8)).astype(float)
    model = quality.fit(x, y)
    new = rng.random((400, len(FEATURES)))
    want = (new[:, 3] > 0.4) & (new[:, 7] < 0.8)
    assert ((model.score(new) > 0.5) == want).mean() > 0.95


def test_statistics_do_not_depend_on_the_slice():
    some = ["Good text here. And more!", "", "x", "A B C\nA B C\nA B C", "é " * 50, "word " * 400]
    raw = [s.encode() for s in some]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    whole = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, r in enumerate(raw):
        one = quality.statistics(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        np.testing.assert_allclose(one[0], whole[k], rtol=1e-6, atol=1e-9)
