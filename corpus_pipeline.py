"""The corpus pipeline: quality, near duplicates, decontamination, sanitising, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import Work, table, with_uid
from mnemora.llm.decontamination import decontaminate
from mnemora.llm.ngram_join import ngram_jaccard_join
from mnemora.llm.packing import pack_documents
from mnemora.llm.pii import sanitise
from mnemora.llm.quality import classify_quality

KEYS = ["row_id", "row_null", "row_text"]


def _names(columns: list[str]) -> list[str]:
    """Names of the key columns that no column of the documents has."""
    taken = {c.lower() for c in columns}
    return [next(n for k in range(len(taken) + 1) if (n := name + "_" * k) not in taken) for name in KEYS]


def _keys(doc_id, text_hash, names: list[str]) -> list:
    """What tells rows apart: doc_id, null too, and a hash of the text."""
    return [c.alias(n) for c, n in zip((F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), text_hash), names, strict=True)]


def _hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    names = _names(docs.columns)
    return docs.select("*", *_keys(F.col("doc_id"), _hash(), names)), names


def _keep(docs: DataFrame, kept: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs whose doc_id and text are among `kept` (kept_id, kept_text: a hash); with `once` one row for
    each doc_id and text, that whose columns have the least hash. The texts are shuffled once."""
    rows, names = _keyed(docs)
    if once:
        order = F.xxhash64(F.to_json(F.struct(*docs.columns)))
        rows = rows.groupBy(*names).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select(*names, "row.*")
    good = kept.select(*_keys(F.col("kept_id"), F.col("kept_text"), names)).distinct()
    return rows.join(good, names, "left_semi").select(*docs.columns)


def _numbered(docs: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The docs with a number for each doc_id and text as doc_id, in order of the doc_ids; and (uid, kept_id, kept_text)."""
    rows = with_uid(docs, work)
    return rows.select(F.col("uid").alias("doc_id"), "text"), rows.select("uid", F.col("doc_id").alias("kept_id"), _hash().alias("kept_text")).distinct()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    Every row is decided by its own text: rows of one doc_id, and rows without doc_id, may part ways. Null texts are
    scored as empty; repeated rows share their fate; an empty table stays empty; all columns are kept as they are.
    """
    good = classify_quality(docs, table(spark, sf_dir, "labels"), keyed=True).where("predicted = 1")
    return _keep(docs, good.select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of linked documents.

    Rows without doc_id come first. Rows of one doc_id with different texts are documents of their own (the one with
    the smaller hash of the text first); of rows that repeat doc_id and text one stays. Documents without words (null
    and empty texts too) link with nothing and stay. An empty table stays empty.
    """
    with Work(spark, "near-duplicates") as work:
        rows, names = _numbered(docs, work)
        first = ngram_jaccard_join(rows).where("doc_id = component_id").select(F.col("doc_id").alias("uid"))
        good = work.keep(names.join(first, "uid", "left_semi"), "first")
    return _keep(docs, good, once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Every row is decided by its own text, whatever its doc_id; null and empty texts stay; repeated rows share their
    fate; an empty table stays empty, and without items all rows stay.
    """
    with Work(spark, "decontamination") as work:
        rows, names = _numbered(docs, work)
        clean = decontaminate(rows, table(spark, sf_dir, "benchmark")).where("not contaminated").select(F.col("doc_id").alias("uid"))
        good = work.keep(names.join(clean, "uid", "left_semi"), "clean")
    return _keep(docs, good)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced; n_chars is that of the new text. Null texts stay null (n_chars too),
    empty ones empty; repeated rows give repeated rows; a null doc_id is one like any other; an empty table stays empty."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in training sequences. Null texts count as empty and hold the end id alone; repeated rows
    and rows without doc_id are packed each; an empty table gives no piece."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Work(spark, "pipeline") as work:
        for name, stage in STAGES[:-1]:
            before, docs = docs, work.save(stage(spark, docs, sf_dir), name)
            work.drop(before)
        docs = work.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
