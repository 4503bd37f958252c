"""Readers and writers: tables, reports, metric rows, and the ports for models."""

from __future__ import annotations

import hashlib
import html
import json
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import tokenize

BLOBS = DOUBLES = 20


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_report(df: DataFrame, title: str, most: int = 500) -> str:
    """A page with the first `most` rows of a small result."""
    rows = df.limit(most).collect()
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    line = lambda tag, xs: "<tr>" + "".join(cell(tag, x) for x in xs) + "</tr>"
    return f"<!doctype html><title>{html.escape(title)}</title><table>{line('th', df.columns)}{''.join(line('td', r) for r in rows)}</table>"


def metric_rows(df: DataFrame, name: str, tags: list[str], values: list[str], index: Column, weight: Column | None = None) -> DataFrame:
    """Positional metric rows: index, tags as blobs, values as doubles, and the weight of the sample."""
    if len(tags) > BLOBS or len(values) > DOUBLES:
        raise ValueError(f"at most {BLOBS} tags and {DOUBLES} values")
    blobs = [F.col(t).cast("string").alias(f"blob{k}") for k, t in enumerate(tags, 2)]
    doubles = [F.col(v).cast("double").alias(f"double{k}") for k, v in enumerate(values, 1)]
    return df.select(index.cast("string").alias("index1"), F.lit(name).alias("blob1"), *blobs, *doubles, (F.lit(1) if weight is None else weight).cast("long").alias("weight"))


# --- ports: what a model does in production has a deterministic stand-in ----------------------------


class Embedder(Protocol):
    dimensions: int

    def column(self, text: Column) -> Column: ...


class Reranker(Protocol):
    model: str

    def score(self, query: Column, text: Column) -> Column: ...


class HashEmbedder:
    """Signed feature hashing of a text's words, normalised: the same text has the same vector anywhere."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def column(self, text: Column) -> Column:
        size = self.dimensions

        @F.pandas_udf("array<double>")
        def embed(hashes: pd.Series) -> pd.Series:
            def one(h):
                v = np.zeros(size)
                h = np.asarray(h, dtype=np.int64)
                np.add.at(v, (h >> 1) % size, np.where(h & 1, 1.0, -1.0))
                return v / (np.linalg.norm(v) or 1.0)

            return hashes.map(one)

        return embed(F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)))


class LexicalReranker:
    """Share of the query's words that a text holds."""

    model = "lexical"

    def score(self, query: Column, text: Column) -> Column:
        asked = tokenize(query)
        return F.size(F.array_intersect(asked, tokenize(text))) / F.greatest(F.size(asked), F.lit(1))


# --- recorded answers of models, for replay in tests ------------------------------------------------


def fixture_key(kind: str, parts: list) -> str:
    """The key of a request: its kind and a hash of its parts as JSON."""
    text = json.dumps([kind, *parts], separators=(",", ":"), ensure_ascii=False)
    return f"{kind}:{hashlib.sha256(text.encode()).hexdigest()[:32]}"


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, request, response) of recorded exchanges: JSON files with an object of entries by key. Requests and
    responses stay JSON text."""
    entries = F.from_json(F.get_json_object("value", "$.entries"), "map<string,string>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("key", "entry"))
    part = lambda name: F.get_json_object("entry", f"$.{name}").alias(name)
    return rows.select("key", F.split_part("key", F.lit(":"), F.lit(1)).alias("kind"), part("request"), part("response"))


def replayed(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (key, ...) with the recorded response; one that nobody recorded is an error, never an invented answer."""
    met = requests.join(recorded.select("key", "response", F.lit(True).alias("met_")), "key", "left")
    missing = F.raise_error(F.concat(F.lit("no fixture for "), F.coalesce("key", F.lit("null"))))
    return met.withColumn("response", F.when(F.col("met_").isNull(), missing.cast("string")).otherwise(F.col("response"))).drop("met_")
