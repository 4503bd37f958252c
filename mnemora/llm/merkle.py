"""A Merkle tree over a dataset: one subroot per language, one root, and a proof for every document.

The leaves of a group are numbered in order of doc_id. A level is made by a window over (group, parent): its
ordered list of the run's digests is the parent's preimage and holds the siblings. Runs have eight nodes, so
no task depends on a group's size. On the way down each node passes the siblings of its own run and of all
runs above it to its children: eight documents share what is shuffled. Digests are kept as 32 bytes; what is
hashed is their hexadecimal text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.llm.common import Work
from mnemora.operators.numbering import numbered_within

FANOUT = 8
DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 3  # a document in so many has its text's capitals lower-cased
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    """The SHA-256 of a text, as bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def joined(parts: Column) -> Column:
    """Byte strings, one behind the other."""
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return hashed(F.concat(*[field(row[c]) for c in COLUMNS]))


def grown(nodes: DataFrame, work: Work) -> list[DataFrame]:
    """The levels over nodes (grp, index, size, digest), themselves first; size is the number of nodes that their group
    has in the level, and run the digests below a node. A group ends in the level where it has one node."""
    levels, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        rows = levels[-1].where("size > 1").select("grp", "index", "size", "digest", F.expr(f"index div {FANOUT}").alias("parent"))
        run = W.partitionBy("grp", "parent").orderBy("index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumn("run", F.collect_list("digest").over(run))
        once = rows.where(F.col("index") == F.col("parent") * FANOUT)  # each run's first node stands for the parent
        above = once.select("grp", F.col("parent").alias("index"), F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"), joined(F.col("run")).alias("run"))
        levels.append(work.save(above.withColumn("digest", hashed(hexed(F.col("run")))), "level"))
        most = -(-most // FANOUT)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(grp, digest) of the nodes that remain."""
    out = levels[0].where("size = 1").select("grp", "digest")
    for level in levels[1:]:
        out = out.unionByName(level.where("size = 1").select("grp", "digest"))
    return out


def descended(levels: list[DataFrame], start: DataFrame, carried: list[str]) -> DataFrame:
    """The first level's rows with their path: what stands left and right of them in their run, then the same of each
    node above, and behind that the path of their group in start (grp, path, carried columns)."""
    above, begin = None, start.select(F.col("grp").alias("grp_"), "path", *carried)
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k]
        last = own.where("size = 1").join(begin, F.col("grp") == F.col("grp_")).select(*own.columns, "path", *carried)
        if above is not None:
            place = (F.col("index") % FANOUT).cast("int") * DIGEST
            beside = F.struct(F.substring("run_", F.lit(1), place).alias("left"), F.substring("run_", place + DIGEST + 1, F.lit(FANOUT * DIGEST)).alias("right"))
            up = above.select(F.col("grp").alias("grp_"), F.col("index").alias("index_"), F.col("run").alias("run_"), F.col("path").alias("path_"), *carried)
            met = own.where("size > 1").join(up, (F.col("grp") == F.col("grp_")) & (F.expr(f"index div {FANOUT}") == F.col("index_")))
            last = met.select(*own.columns, F.concat(F.array(beside), "path_").alias("path"), *carried).unionByName(last)
        above = last
    return above


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    A field that is null counts as `-`; a null lang is a group of its own and comes first, a null doc_id comes before
    the others of its group and is never tampered with. Rows of one doc_id are ordered by their leaf; rows that are
    equal in all five fields have leaves of their own next to each other. A group of one document has its leaf as
    subroot, a dataset of one group its subroot as root; a document without siblings has the digest of nothing as
    proof. An empty table gives no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    row = {c: F.col(c) for c in COLUMNS}
    hit = F.crc32(row["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    changed = leaf(row | {"text": F.translate("text", CAPITALS, SMALL)})
    # a group is never null, and its order is that of the languages' bytes, null first
    group = F.when(row["lang"].isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    with Work(spark, "merkle") as work:
        leaves = work.save(docs.select(row["doc_id"].alias("doc_id"), group.alias("grp"), leaf(row).alias("digest"), F.when(hit, changed).alias("changed")), "leaves")
        nodes = work.save(numbered_within(leaves, ["grp"], ["doc_id", "digest"], save=work.save), "nodes")
        work.drop(leaves)
        levels = grown(nodes, work)
        subroots = work.save(tops(levels).select(F.lit("").alias("top"), F.col("grp").alias("own"), "digest"), "subroots")
        ordered = numbered_within(subroots, ["top"], ["own"], save=work.save).withColumnRenamed("top", "grp")
        upper = grown(work.save(ordered, "ordered"), work)
        root = tops(upper).select("grp", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.col("digest").alias("root"))
        start = descended(upper, root, ["root"]).select(F.col("own").alias("grp"), "path", "root", F.col("digest").alias("subroot"))
        rows = descended(levels, start, ["root", "subroot"])
        proof = F.aggregate("path", F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"]))
        folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda a, s: hashed(hexed(F.concat(s["left"], a, s["right"]))))
        rows = rows.select("doc_id", "digest", "subroot", "root", F.sha2(hexed(proof).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded"))
        out = rows.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), "proof_sha256", hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
        return work.keep(out)
