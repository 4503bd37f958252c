from pyspark.sql import functions as F

import corpus_pipeline as P
from mnemora.llm import quality as Q
from tests.llm.cases import documents
from tests.llm.test_decontamination import Q1, bench


def tables(spark, folder):
    docs = documents(spark, 20, 60)
    extra = [(900, f"{' '.join(f'k{i}' for i in range(60))} {Q1}", "en", "s", 0, "u", "c"), (901, "write to someone@example.org " + " ".join(f"m{i}" for i in range(50)), "en", "s", 0, "u", "c")]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300 or i >= 900), 0) for i in [*range(300), *range(300, 312), 900, 901]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench(spark).write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_stages(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {k: set(v) for k, v in kept.items()}
    assert 900 in ids["near_duplicates"] and 900 not in ids["decontamination"] and 901 in ids["decontamination"]
    assert ids["pii"] == ids["decontamination"] and kept["pii"][901].startswith("write to [EMAIL]")
    packed = P.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.collect()} == ids["pii"]
    assert sorted(map(tuple, P.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_one_of_each_group_stays(spark):
    docs = documents(spark, 21, 60, odd=False)
    from mnemora.llm.ngram_join import ngram_jaccard_join

    groups = {r.component_id for r in ngram_jaccard_join(docs).collect()}
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == sorted(groups)


def test_rows_of_one_doc_id_are_decided_each(spark, tmp_path):
    clean = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    leak = f"{' '.join(f'k{i}' for i in range(60))} {Q1}"
    rows = [(None, clean[0]), (None, clean[1]), (None, leak), (7, clean[2]), (7, clean[3]), (7, clean[3]), (7, leak), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda x: sorted(map(str, x))
    once = P.near_duplicates(spark, docs.where("doc_id is null or doc_id <> 8"), "")
    assert order(map(tuple, once.where(~F.col("text").contains("k59")).collect())) == order([rows[0], rows[1], rows[3], rows[4]])
    left = P.decontamination(spark, docs, f"file://{tmp_path}")
    assert order(map(tuple, left.collect())) == order(r for r in rows if r[1] != leak)


def test_quality_decides_each_text(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(None, "good text"), (None, "bad text"), (7, "bad text"), (7, "good text"), (9, "bad text")], "doc_id long, text string")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    class Model:
        def score(self, x):
            return (x[:, Q.FEATURES.index("bytes")] > 2.25).astype(float)  # log1p(9) against log1p(8)

    monkeypatch.setattr(Q, "fit", lambda *a: Model())
    got = P.quality(spark, docs, f"file://{tmp_path}").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, "good text"), (7, "good text")]))
