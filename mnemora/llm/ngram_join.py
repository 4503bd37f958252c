"""Operator 1: n-gram Jaccard self-join by vertical partitioning.

Documents are sets of distinct 5-word shingles; two link when 100 * |A & B| >= 80 * |A | B|. Equal
sets are one class from the start. The rest goes in three steps, all exact:

1. Who can have a partner at all. In hash order, partners share at least `need(n)` of the first
   `reach(n)` shingles. Each task combines these shingles first: what it meets twice is shared
   already and becomes one row, so no shingle, however common, is more than a row per task.
2. For the few documents left, shingles get a global order, rare before common. Shingles of no
   second document can't overlap; a document whose shared ones are under 80 % drops out.
3. The global order is cut into fragments. A pair is compared fragment by fragment: the partial
   overlaps are counted separately and summed per pair. Pairs come from prefix buckets (partners meet
   in one). Within a bucket documents are first compared with one leader, in rounds; whoever links is
   in the leader's component and needs no other pair with it. The pairs that a bucket still holds between
   different components are sifted within tasks by an upper bound of their overlap: first, in rounds, the
   likeliest partner of each document is compared, and at the end all pairs that the bound can't rule
   out, so no link between components is lost.

Only pairs that decide a component are counted. Documents without words link with nothing. Null texts
count as empty, a null doc_id as the smallest, repeated rows link with each other, other columns are
ignored, and an empty table gives no rows. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.llm.common import HOT, MANY, Work, components, groups, hot_keys, list_array, looked_up, mix, on_batches, per_slice, shingle_sets, signed, with_uid, word_hashes

WORDS = 5
PERCENT = 80
ROUNDS, BEST_ROUNDS = 1, 2
CHUNK = 512
BINS = 256
FLUSH = 2_000_000


def least_overlap(n):
    """ceil(0.8 n): what a set of n shares with any partner at least."""
    return (4 * n + 4) // 5


def reach(n):
    return n - least_overlap(n) + 1 + n // 10


def need(n):
    return 1 + least_overlap(n) // 10


def _sql(template: str, n: str = "n") -> str:
    return template.replace("least(n)", f"(4 * {n} + 4) div 5")


def _sets(data, offsets):
    return shingle_sets(*word_hashes(data, offsets), WORDS)


def _total(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def signatures(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, n, s1, s2): equal sets have equal n, s1 and s2."""

    def kernel(batch):
        for i, j, data, offsets in per_slice(batch.column(2)):
            h, bounds = _sets(data, offsets)
            yield pa.record_batch(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(signed(_total(mix(h), bounds))), pa.array(signed(_total(mix(h + np.uint64(1)), bounds)))],
                names=["uid", "doc_id", "n", "s1", "s2"],
            )

    return on_batches(rows, ["uid", "doc_id", "text"], kernel, "uid long, doc_id long, n long, s1 long, s2 long")


def with_shared_prefix(rows: DataFrame) -> DataFrame:
    """(uid, hits): shingles of the prefix in hash order that some other row has in its own."""

    def run(batches):
        held, size = [], 0

        def flush():
            g, uid = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(g, kind="stable")
            g, uid = g[order], uid[order]
            edge = np.concatenate(([True], g[1:] != g[:-1], [True]))
            alone = edge[1:] & edge[:-1]
            first = edge[:-1] & ~alone
            owner, hits = np.unique(uid[~alone], return_counts=True)
            for keys, ids, mask, count in (
                (g[alone], uid[alone], None, np.zeros(int(alone.sum()), np.int32)),
                (g[first], np.zeros(int(first.sum()), np.int64), np.ones(int(first.sum()), bool), np.zeros(int(first.sum()), np.int32)),
                (mix(owner.view(np.uint64)), owner, None, hits.astype(np.int32)),
            ):
                for lo in range(0, len(keys), 100_000):
                    at = slice(lo, lo + 100_000)
                    yield pa.record_batch([pa.array(signed(keys[at])), pa.array(ids[at], mask=None if mask is None else mask[at]), pa.array(count[at])], names=["g", "uid", "hits"])

        for batch in batches:
            for i, j, data, offsets in per_slice(batch.column(1)):
                h, bounds = _sets(data, offsets)
                n = np.diff(bounds)
                uid = np.repeat(batch.column(0).slice(i, j - i).to_numpy(), n)
                rank = np.arange(len(h)) - np.repeat(bounds[:-1], n)
                front = rank < np.repeat(reach(n), n)
                held.append((h[front], uid[front]))
                size += int(front.sum())
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    met = rows.select("uid", "text").mapInArrow(run, "g long, uid long, hits int")
    weight = F.when(F.col("hits") > 0, 0).when(F.col("uid").isNull(), 2).otherwise(1)
    met = met.withColumn("met", F.sum(weight).over(W.partitionBy("g")))
    return met.where("uid is not null and (hits > 0 or met >= 2)").groupBy("uid").agg(F.sum(F.greatest("hits", F.lit(1))).alias("hits"))


def ordered_sets(rows: DataFrame, work: Work) -> DataFrame:
    """(id, n, c, g, pos, s): the shared shingles of documents that can still have a partner, in global order.

    c is the logarithm of a shingle's document count: the order is c, then the hash.
    """

    def kernel(batch):
        for _, _, data, offsets in per_slice(batch.column(1)):
            h, bounds = _sets(data, offsets)
            yield pa.record_batch([pa.array(signed(_total(mix(h), bounds))), pa.array(np.diff(bounds)), list_array(signed(h), bounds, pa.int64())], names=["id", "n", "grams"])

    sets = work.save(on_batches(rows, ["uid", "text"], kernel, "id long, n long, grams array<long>"), "sets")
    grams = sets.select("id", "n", F.explode("grams").alias("g"))
    counted = work.save(grams.groupBy("g").agg(F.count("*").alias("df")).where("df >= 2"), "counted")
    hot = hot_counts(counted, "df")
    ranked = counted.select("g", F.floor(F.log2("df")).cast("int").alias("c"))
    shared = looked_up(grams, ranked, "g", hot).groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("c", "g"))).alias("sorted"))
    return shared.withColumn("s", F.size("sorted").cast("long")).where("s >= (4 * n + 4) div 5")


def hot_counts(counted: DataFrame, size: str) -> list:
    """The shingles that hold more than 1/HOT of the rows, of their counts: fewer than HOT."""
    total = counted.agg(F.sum(size)).first()[0] or 0
    return [r.g for r in counted.where(F.col(size) * HOT > max(total, MANY)).select("g").collect()]


def _fits(a: str, b: str) -> str:
    """Whether sets of these sizes and shared sizes could reach the threshold."""
    most = f"least({a}.s, {b}.s)"
    return f"100 * {most} >= {PERCENT} * ({a}.n + {b}.n - {most})"


class _Comparer:
    """Exact comparison of id pairs, fragment by fragment."""

    def __init__(self, ordered: DataFrame, work: Work):
        cell = ordered.select("id", F.posexplode("sorted").alias("pos", "e")).select("id", (F.col("e.c") * 4 + F.shiftrightunsigned("e.g", 62)).cast("int").alias("fragment"), "e.g")
        self.fragments = work.save(cell.groupBy("id", "fragment").agg(F.collect_list("g").alias("grams")), "fragments")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b, na, nb), the pairs that link."""
        left = self.fragments.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("ga"))
        right = self.fragments.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("gb"))
        part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("partial"))
        total = part.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
        return total.where(f"100 * overlap >= {PERCENT} * (na + nb - overlap)").select("a", "b")


def linked_classes(ordered: DataFrame, work: Work, rounds: int = ROUNDS, best_rounds: int = BEST_ROUNDS) -> DataFrame | None:
    """(node, component) over set ids, for sets that link with a different one; None without any."""
    compare = _Comparer(ordered, work)
    front = F.slice("sorted", F.lit(1), (F.col("s") - F.expr("(4 * n + 4) div 5") + 1).cast("int"))
    buckets = ordered.select("id", "n", "s", F.explode(front).alias("e")).select("id", "n", "s", "e.g")
    many = work.save(buckets.groupBy("g").agg(F.count("*").alias("size")).where("size >= 2"), "many")
    hot = hot_counts(many, "size")
    buckets = work.save(looked_up(buckets, many.select("g"), "g", hot), "buckets")
    edges = label = None

    def labelled():
        if label is None:
            return buckets.withColumn("label", F.col("id"))
        return buckets.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    def grown(found: DataFrame):
        """Adds the links of these pairs, and tells whether there are any."""
        nonlocal edges, label
        new = work.save(compare.linked(found), "edges")
        if new.isEmpty():
            return False
        edges = new if edges is None else edges.union(new)
        label = components(edges, work)
        return True

    for turn in range(rounds):
        rows = labelled()
        lead = rows.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("id", "n", "s", "label"), F.xxhash64("id", F.lit(turn))).alias("l")).where("lo <> hi").select("g", "l")
        near = looked_up(rows, lead, "g", hot).where(f"label <> l.label and {_fits('x', 'l').replace('x.', '')}")
        met = near.groupBy("id", "n", "l").agg(F.count("*").alias("shared"))
        one = met.groupBy("id", "n").agg(F.max_by("l", F.struct("shared", F.xxhash64("l.id", F.lit(turn)))).alias("l"))
        if not grown(one.select(F.col("id").alias("a"), F.col("l.id").alias("b"), F.col("n").alias("na"), F.col("l.n").alias("nb"))):
            break
    bins = None
    for left in range(best_rounds, -1, -1):
        # the buckets that hold several components, with the largest of each
        rows = labelled()
        by_label = rows.groupBy("g", "label").agg(F.count("*").alias("size"))
        main = by_label.groupBy("g").agg(F.sum("size").alias("all"), F.count("*").alias("labels"), F.max_by(F.struct("label", "size"), F.struct("size", "label")).alias("main")).where("labels >= 2")
        mixed = work.save(looked_up(rows, main.select("g", F.col("main.label").alias("main"), (F.col("all") - F.col("main.size")).alias("xs"), "all"), "g", hot), "mixed")
        if mixed.isEmpty():
            break
        if bins is None:
            bins = work.save(summaries(ordered.join(mixed.select("id").distinct(), "id", "left_semi")), "summaries")
        pairs = possible_pairs(mixed.join(bins, "id"), best=left > 0)
        if left:
            best = pairs.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("share", "b")).alias("p"))
            more = grown(best.select("a", F.col("p.b").alias("b"), "na", F.col("p.nb").alias("nb")))
        else:
            more = grown(pairs.select("a", "b", "na", "nb").distinct())
        work.drop(mixed)
    return label


def summaries(ordered: DataFrame) -> DataFrame:
    """(id, bins): how many shared shingles of a set fall into each of BINS hash bins. The sum of two sets' bin-wise
    minima is at least their overlap."""

    def kernel(batch):
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            n = part.column(1).value_lengths().to_numpy()
            g = part.column(1).flatten().to_numpy().view(np.uint64)
            at = np.repeat(np.arange(part.num_rows), n) * BINS + (mix(g) % np.uint64(BINS)).astype(np.int64)
            count = np.minimum(np.bincount(at, minlength=part.num_rows * BINS), 65535).astype("<u2")
            size = 2 * BINS
            yield pa.record_batch([part.column(0), pa.array([count[k * BINS : (k + 1) * BINS].tobytes() for k in range(part.num_rows)], type=pa.binary(size)).cast(pa.binary())], names=["id", "bins"])

    return on_batches(ordered.select("id", F.transform("sorted", lambda e: e["g"]).alias("grams")), ["id", "grams"], kernel, "id long, bins binary")


def possible_pairs(mixed: DataFrame, chunk: int = CHUNK, best: bool = False) -> DataFrame:
    """(a, b, na, nb, share): pairs of a bucket in different components whose sizes and summaries allow a link; with
    `best` only the likeliest of each x and block. share is the largest Jaccard similarity that the summaries allow.

    Rows outside the bucket's largest component (x) meet all rows (y), in blocks of x and y: what is dealt is a row
    per block it belongs to, and no pair leaves a task but those that the summaries can't rule out.
    """
    xs, ys = (F.greatest(F.ceil(F.col(c) / chunk), F.lit(1)).cast("int") for c in ("xs", "all"))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    columns = ["g", "id", "label", "n", "s", "bins"]
    x = mixed.where("label <> main").select(*columns, part(xs).alias("i"), F.explode(F.sequence(F.lit(0), ys - 1)).alias("j"), F.lit(True).alias("is_x"), F.lit(False).alias("in_main"))
    y = mixed.select(*columns, F.explode(F.sequence(F.lit(0), xs - 1)).alias("i"), part(ys).alias("j"), F.lit(False).alias("is_x"), (F.col("label") == F.col("main")).alias("in_main"))
    names = ["g", "i", "j", "is_x", "id", "label", "n", "s", "in_main", "bins"]

    def solve(block):
        is_x, ids, label, n, s, in_main = (block.column(k).to_numpy(zero_copy_only=False) for k in range(3, 9))
        wide = np.frombuffer(b"".join(block.column(9).to_pylist()), dtype="<u2").reshape(len(ids), BINS)
        right = np.flatnonzero(~is_x)
        found = []
        for k in np.flatnonzero(is_x):
            most = np.minimum(s[k], s[right])
            ok = (label[right] != label[k]) & (in_main[right] | (ids[right] > ids[k])) & (100 * most >= PERCENT * (n[k] + n[right] - most))
            near = right[ok]
            most = np.minimum(wide[k], wide[near]).sum(axis=1, dtype=np.int64)
            share = most / (n[k] + n[near] - most)
            ok = np.flatnonzero(100 * most >= PERCENT * (n[k] + n[near] - most))
            if best and len(ok):
                ok = ok[np.argmax(share[ok]), None]
            if len(ok):
                found.append((np.full(len(ok), k), near[ok], share[ok]))
        if found:
            a, b, share = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.record_batch([pa.array(c) for c in (ids[a], ids[b], n[a], n[b], share)], names=["a", "b", "na", "nb", "share"])

    def run(batches):
        for block in groups(batches, 3):
            yield from solve(block)

    dealt = x.unionByName(y).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.select(*names).mapInArrow(run, "a long, b long, na long, nb long, share double")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    with Work(docs.sparkSession, "ngram-join") as work:
        return work.keep(_joined(with_uid(docs, work), work).drop("uid"))


def _joined(rows: DataFrame, work: Work) -> DataFrame:
    sets = work.save(signatures(rows), "signatures")
    classes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("uid").alias("uid"), F.min_by("doc_id", "uid").alias("smallest"))
    classes = work.save(classes, "classes")
    hits = with_shared_prefix(rows)
    able = classes.join(hits, "uid").where("hits >= 1 + ((4 * n + 4) div 5) div 10").select("uid")
    able = work.save(able, "able")
    ordered = work.save(ordered_sets(rows.join(able, "uid", "left_semi"), work), "ordered")
    label = linked_classes(ordered, work)
    if label is not None:
        named = classes.join(label.withColumnRenamed("node", "s1"), "s1", "left").withColumn("component", F.coalesce("component", "s1"))
        least = named.groupBy("component").agg(F.min_by("smallest", "uid").alias("component_id"))
        total = classes.count()
        linked = looked_up(named, least, "component", hot_keys(named, "component", total))
        classes = linked.select("s1", "s2", "n", "component_id")
    else:
        classes = classes.select("s1", "s2", "n", F.col("smallest").alias("component_id"))
    found = sets.join(classes.withColumn("known", F.lit(True)), ["s1", "s2", "n"], "left")
    return found.select("uid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
