import random

from mnemora.llm.decontamination import decontaminate
from tests.llm.cases import SCHEMA, documents, empty

ITEMS = "item_id long, text string, doc_id long"
Q1 = "If a train leaves Boston at 60 km per hour and Alice waits 3 hours for it, how far away was it when Alice came to the station"
Q2 = "A farmer has 12 cows and sells 5 of them to Peter, who pays 40 dollars for each cow; how much money does Peter pay in all"


def bench(spark):
    return spark.createDataFrame([(1, Q1, 7), (2, Q2, 7), (3, "too short", 7), (4, None, 7), (1, Q1, 8)], ITEMS)


def docs(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"f{rng.randrange(5000)}" for _ in range(n))
    changed = Q1.replace("Boston", "Denver").replace("60 km", "85 miles").replace("Alice", "Karen").replace("3 hours", "7 days")
    torn = Q1.replace("and Alice", "and Karen").replace("60", "61")
    rows = [(1, f"{filler(80)} {Q1} {filler(40)}"), (2, f"{filler(30)} {changed}. {filler(200)}"), (3, filler(300)), (4, f"{filler(20)} {Q2.lower()} {filler(5)}"), (5, None), (6, ""), (7, "how far away was it when"), (8, f"{Q1} {filler(9)} {Q2}"), (9, torn)]
    return spark.createDataFrame([(i, t, "", "", 0, "", "") for i, t in rows], SCHEMA)


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    found = {r.doc_id: r.items for r in decontaminate(docs(spark), bench(spark)).collect()}
    assert found[1] == "1" and found[8] == "1,2"
    assert found[2] == "1"  # re-parameterised: other names, numbers and units, one for each
    assert found[3] == found[5] == found[6] == found[7] == ""


def test_both_joins_agree(spark):
    a, b = (sorted(map(tuple, decontaminate(docs(spark), bench(spark), most=most).collect())) for most in (1_000_000, 0))
    assert a == b


def test_bench_tables(spark):
    d = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = {r.doc_id: set(r["items"].split(",")) - {""} for r in decontaminate(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    for i, text in texts.items():
        whole = {str(r.item_id) for r in items if len(r.text.split()) >= 5 and r.text in text}
        assert whole <= found[i]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate(empty(spark), bench(spark)).count() == 0
    rows = decontaminate(documents(spark, 16, 12), none).collect()
    assert rows and not any(r.contaminated for r in rows)
