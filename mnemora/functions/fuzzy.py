"""Token-sort similarity of names, 0 to 100: 2 * LCS / (both lengths) over the sorted words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ODD = re.compile(r"[^\w]|_")


def sorted_words(text: str) -> str:
    return " ".join(sorted(_ODD.sub(" ", text).lower().split()))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer per row."""
    places: dict[str, int] = {}
    for k, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> int:
    a, b = sorted_words(a), sorted_words(b)
    if not a or not b:
        return 0
    return int(200 * common_length(a, b) / (len(a) + len(b)) + 0.5)


def token_sort_ratio_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort_ratio(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return score(a, b)
