"""Operator 6: quality classifier, histogram gradient-boosted trees over document statistics.

The statistics of all whole texts are computed batch-wise and kept in a table of a few dozen numbers a
document. The trees are fitted in numpy on a bounded sample of labelled training rows (about SAMPLE at
most, taken by a hash of doc_id) and flattened into arrays, so scoring is a gather per tree level.

Null texts count as empty; documents without words get a score as well; repeated rows are scored
each; a null doc_id is no held-out row and has no label; labels are reduced to one per doc_id (the largest); other
columns are ignored; an empty table gives no rows. With no label or
only one class in the sample the score is the smoothed rate of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Work, crc_bucket, on_batches, per_slice, shingle_sets, span_hash, lowered, word_spans

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, MIN_ROWS, RIDGE = 60, 4, 0.2, 64, 20, 1.0

CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "wide": range(0x80, 0x100),
    "blank": (0x20, 0x09, 0x0B, 0x0C, 0x0D),
    "newline": (0x0A,),
    "stop": b".,;:?",
    "bang": b"!",
    "symbol": b"#$%&*^~=<>",
    "bar": b"|/\\_",
    "bracket": b"()[]{}",
    "at": b"@+",
}
FEATURES = [*CLASSES, "bytes", "words", "word_mean", "word_max", "word_long", "distinct", "repeat", "top", "top2", "entropy", "bigrams", "shingles", "upper_words", "symbol_words", "lines", "line_distinct", "line_mean", "line_short", "line_max"]


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys per owner; then owner and count of each distinct key."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])))) if len(o) else np.zeros(0, dtype=np.int64)
    return np.bincount(o[new], minlength=n).astype(float), o[new], np.diff(np.append(new, len(o)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of a slice."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    out = {}
    for name, members in CLASSES.items():
        mask = np.zeros(256, dtype=bool)
        mask[list(members)] = True
        out[name] = _per_doc(mask[data], offsets) / size
    low = lowered(data)
    starts, ends, docs = word_spans(low, offsets)
    owner = np.repeat(np.arange(n), np.diff(docs))
    words = np.maximum(np.diff(docs), 1).astype(float)
    keys = span_hash(low, starts, ends)
    length = ends - starts
    out["bytes"] = np.log1p(np.diff(offsets))
    out["words"] = np.log1p(np.diff(docs))
    out["word_mean"] = _per_doc(length, docs) / words
    out["word_max"] = np.zeros(n)
    np.maximum.at(out["word_max"], owner, length)
    out["word_long"] = _per_doc(length > 15, docs) / words
    distinct, group, count = _distinct(owner, keys, n)
    out["distinct"] = distinct / words
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    out["repeat"] = _per_doc(same, docs) / words
    top = np.zeros(n)
    np.maximum.at(top, group, count)
    out["top"] = top / words
    out["top2"] = np.bincount(group, weights=count.astype(float) ** 2, minlength=n) / words**2
    out["entropy"] = np.log(words) - np.bincount(group, weights=count * np.log(count), minlength=n) / words
    pair = keys[1:] * np.uint64(0x9E3779B97F4A7C15) + keys[:-1]
    inside = owner[1:] == owner[:-1]
    out["bigrams"] = _distinct(owner[1:][inside], pair[inside], n)[0] / np.maximum(words - 1, 1)
    _, sets = shingle_sets(keys, docs)
    out["shingles"] = np.diff(sets) / np.maximum(words - 4, 1)
    first = data[starts]
    last = data[ends - 1]
    second = data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(data) else first
    upper = (first >= 0x41) & (first <= 0x5A)
    out["upper_words"] = _per_doc(upper & (second >= 0x41) & (second <= 0x5A) & (length > 1), docs) / words
    odd = np.zeros(256, dtype=bool)
    odd[list(b"#$%&*!^~=|<>")] = True
    out["symbol_words"] = _per_doc(odd[last], docs) / words
    edge = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 0x0A) + 1)))
    edge = edge[edge < len(data)]
    line_end = np.append(edge[1:], len(data))
    line_owner = np.searchsorted(offsets, edge, side="right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1).astype(float)
    line_size = line_end - edge
    out["lines"] = np.log1p(lines)
    out["line_distinct"] = _distinct(line_owner, span_hash(low, edge, line_end), n)[0] / lines
    out["line_mean"] = np.log1p(np.bincount(line_owner, weights=line_size, minlength=n) / lines)
    out["line_short"] = np.bincount(line_owner, weights=line_size < 20, minlength=n) / lines
    line_max = np.zeros(n)
    np.maximum.at(line_max, line_owner, line_size)
    out["line_max"] = np.log1p(line_max)
    return np.stack([out[f] for f in FEATURES], axis=1)


def statistics_table(docs: DataFrame) -> DataFrame:
    def kernel(batch):
        for i, j, data, offsets in per_slice(batch.column(1)):
            rows = statistics(data, offsets).astype(np.float32)
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["doc_id", "row", "x"])

    row = F.xxhash64(F.coalesce("text", F.lit("")))
    return on_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row")), ["doc_id", "text", "row"], kernel, "doc_id long, row long, x array<float>")


@dataclass
class Trees:
    """All trees as arrays of (tree, node); a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int32)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[row, self.feature[t, node]] <= self.cut[t, node]
            node = np.where(go_left, self.left[t, node], self.right[t, node])
        raw = self.bias + self.value[t, node].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, min_rows: int = MIN_ROWS, ridge: float = RIDGE) -> Trees:
    nodes = (1 << (depth + 1)) - 1
    p = (y.sum() + 1) / (len(y) + 2)
    empty = Trees(np.zeros((1, 1), np.int32), np.zeros((1, 1)), np.zeros((1, 1), np.int32), np.zeros((1, 1), np.int32), np.zeros((1, 1)), float(np.log(p / (1 - p))), 0)
    if not 0 < y.sum() < len(y):
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    width = bins
    shape = (trees, nodes)
    feature, cut, value = np.zeros(shape, np.int32), np.full(shape, np.inf), np.zeros(shape)
    left = np.tile(np.arange(nodes, dtype=np.int32), (trees, 1))
    right = left.copy()
    raw = np.full(len(y), empty.bias)
    columns = np.arange(x.shape[1]) * width
    for t in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        at = np.zeros(len(y), dtype=np.int64)
        live = [0]
        for level in range(depth):
            split = []
            for node in live:
                rows = np.flatnonzero(at == node)
                if len(rows) < 2 * min_rows:
                    continue
                cell = (code[rows] + columns).ravel()
                hist = [np.bincount(cell, weights=np.repeat(v, x.shape[1]), minlength=width * x.shape[1]).reshape(-1, width).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = (a[:, :-1] for a in hist)
                gt, ht, nt = (a[:, -1:] for a in hist)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < min_rows) | (nt - nl < min_rows)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                feature[t, node], cut[t, node] = f, cuts[f][b]
                left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
                at[rows] = np.where(code[rows, f] <= b, 2 * node + 1, 2 * node + 2)
                split += [2 * node + 1, 2 * node + 2]
            live = split
        totals = [np.bincount(at, weights=v, minlength=nodes) for v in (g, h)]
        value[t] = -rate * totals[0] / (totals[1] + ridge)
        raw += value[t, at]
    return Trees(feature, cut, left, right, value, empty.bias, depth)


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, threshold: float = THRESHOLD, keyed: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; where `keyed`, also row, the hash of its text."""
    with Work(docs.sparkSession, "quality") as work:
        stats = work.save(statistics_table(docs), "statistics")
        known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
        known = work.save(known.where(crc_bucket(F.col("doc_id"), folds) != 0), "labels")
        share = min(1.0, sample / max(known.count(), 1))  # of all labels: about `sample` rows at most come to the driver
        few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31)))
        chosen = stats.join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
        x = np.stack(chosen["x"].to_numpy()) if len(chosen) else np.zeros((0, len(FEATURES)), np.float32)
        # cuts are halves of float32 values, so training and scoring see the same side
        model = fit(x.astype(np.float64), (chosen["quality"].to_numpy(dtype=float) >= 1).astype(float))

        def kernel(batch):
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                rows = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(model.score(rows))], names=["doc_id", "row", "score"])

        scored = on_batches(stats, ["doc_id", "row", "x"], kernel, "doc_id long, row long, score double")
        held_out = F.coalesce(crc_bucket(F.col("doc_id"), folds) == 0, F.lit(False))
        out = scored.select("doc_id", *["row"] * keyed, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
        return work.keep(out)
