"""How filters overlap: what each of five removes, alone and in every order of applying them.

A document's failures are a mask of five bits. The counts of a part's masks give its removal polynomial,
the multilinear extension of "how many documents fail a filter of the set": with p_i = 1 where filter i is
applied and 0 where not,

    R(p) = sum over masks m of n(m) * (1 - product over i in m of (1 - p_i)) = sum over sets T of a(T) * product over i in T of p_i.

Corners of the cube give what any set of filters removes, so survivors of each order's prefixes need no pass
over the documents. A filter's Shapley value is the integral of R's partial derivative along the diagonal,
the sum of a(T) / |T| over the sets T that hold it; times 120 every term is a whole number.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Work

FILTERS = "ABCDE"
ORDERS = 120  # of five filters
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # the last two in percent
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
MEASURES = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits 0 to 3: few words (A), repetitive words (B), many capitals (C), symbols (D)."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    fails = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    )
    mask = F.lit(0)
    for k, f in enumerate(fails):
        mask = mask + F.when(f, 1 << k).otherwise(0)
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame, work: Work) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part have a mask, and how many of them are labelled so.

    Texts meet by a 256-bit digest. The first document of a text is found by an aggregate and then by its own doc_id,
    so many copies of one text are no task's burden.
    """
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    facts = work.save(facts, "masks")
    firsts = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    rows = facts.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in MEASURES[1:]])


def removal_polynomials(counts: DataFrame) -> DataFrame:
    """(part, total, terms): terms has a struct of (set, n, good, toxic), the coefficients, for each set of filters; at
    most 31 a part."""
    within = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda t: t.bitwiseAND(F.col("mask")) == t)
    sign = F.when(F.bit_count("set") % 2 == 1, 1).otherwise(-1)
    spread = counts.select("part", F.explode(within).alias("set"), *MEASURES)
    summed = spread.groupBy("part", "set").agg(*[F.sum(sign * F.col(c)).alias(c) for c in MEASURES])
    terms = F.collect_list(F.when(F.col("set") > 0, F.struct("set", *MEASURES)))
    return summed.groupBy("part").agg(F.sum(F.when(F.col("set") == 0, -F.col("n"))).alias("total"), terms.alias("terms"))


def corner(terms: Column, chosen: Column, measure: str) -> Column:
    """R where the filters of a set are applied: the sum of the coefficients of its subsets."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + F.when(t["set"].bitwiseAND(chosen) == t["set"], t[measure]).otherwise(0))


def diagonal_integral(terms: Column, bit: int, measure: str = "n") -> Column:
    """120 times the integral of R's derivative by one filter along the diagonal: each term of |T| filters gives
    a(T) * t^(|T| - 1), whose integral is a(T) / |T|, and |T| divides 120."""
    share = lambda t: t[measure] * F.element_at(F.array(*[F.lit(ORDERS // k).cast("long") for k in range(1, 6)]), F.bit_count(t["set"]))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + F.when(t["set"].bitwiseAND(F.lit(bit)) > 0, share(t)).otherwise(0))


def steps_of(parts: DataFrame) -> DataFrame:
    """Each row with every order of the filters, step by step: the sets applied before and after."""
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    until = lambda last: sum((F.when(F.instr("filter_order", f) <= last, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    return rows.withColumns({"before": until(F.col("step") - 1), "after": until(F.col("step"))})


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each value
    of lang, each order of the filters and each step of it.

    Null texts count as empty, a null lang as the empty string. A text without words fails A alone: none of its words
    repeats. Copies (E) are those of a strictly smaller doc_id: of rows that repeat a doc_id none is a copy of the
    other, and a row without doc_id neither is a copy nor makes one. A document has a label if any row of its doc_id in
    `labels` says so; rows without doc_id have none. An empty table gives no part. Extra columns are not read.
    """
    with Work(docs.sparkSession, "filters") as work:
        parts = removal_polynomials(mask_counts(docs, labels, work))
        sets = F.sequence(F.lit(0), F.lit(31))
        at_all = lambda measure: F.transform(sets, lambda s: corner(F.col("terms"), s, measure))
        corners = [at_all(c).alias(f"{c}_at") for c in MEASURES]
        shares = F.array(*[diagonal_integral(F.col("terms"), 1 << k) for k in range(5)]).alias("shares")
        steps = steps_of(parts.select("part", "total", *corners, shares))
        at = lambda c, s: F.get(f"{c}_at", s)
        gone = lambda c: at(c, F.col("after")) - at(c, F.col("before"))
        bit = F.col("after") - F.col("before")
        fails, alone = at("n", bit), at("n", F.lit(31)) - at("n", F.lit(31) - bit)
        out = steps.select(
            "part", "filter_order", "step", (F.col("total") - at("n", F.col("after"))).alias("kept"), gone("n").alias("removed"), (fails - gone("n")).alias("redundant"),
            alone.alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shares", F.bit_count(bit - 1)).alias("shapley"),
        )
        return work.keep(out)
