"""Log archive: NDJSON (plain or gzip) in one folder per UTC day, searched by needles in field names and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.times import days_between

MOST_DAYS = 91
COMMON = ["timestamp", "level", "message"]


def archive_paths(root: str, start: str, end: str) -> list[str]:
    days = days_between(start, end)
    if not 1 <= len(days) <= MOST_DAYS:
        raise ValueError(f"a range of 1 to {MOST_DAYS} days is needed")
    return [f"{root}/{d}" for d in days]


def scan_archive(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """(day, record): whole records as text; days without folder are skipped, unreadable lines stay as they are."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in archive_paths(root, start, end) if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return spark.createDataFrame([], "day string, record string")
    return spark.read.text(there).select(F.regexp_extract(F.input_file_name(), r"/(\d{8})/[^/]*$", 1).alias("day"), F.col("value").alias("record"))


def search(records: DataFrame, needles: Sequence[str] | dict[str, str], column: str = "record", limit: int | None = None) -> DataFrame:
    """Records whose text holds all needles, whatever the case. A dict asks for field name and value both."""
    words = [w for pair in needles.items() for w in pair] if isinstance(needles, dict) else list(needles)
    if not words:
        raise ValueError("at least one filter is needed")
    low = F.lower(column)
    out = records
    for w in words:
        out = out.where(F.contains(low, F.lit(w.lower())))
    return out if limit is None else out.orderBy(column).limit(limit)


def fields(records: DataFrame, names: Sequence[str] = COMMON, column: str = "record") -> DataFrame:
    """Named fields of each record as text; what a record lacks is null. Fields off the list are dropped."""
    parsed = F.from_json(column, "map<string,string>")
    return records.select("*", *[parsed[n].alias(n) for n in names])


def as_records(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as JSON text, keys in the order of the columns."""
    return df.select("*", F.to_json(F.struct(*(columns or df.columns))).alias("record"))
