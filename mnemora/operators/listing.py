"""List endpoints: optional filters, ordered pages, keyset pages, enrichment by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.functions.text import encode_cursor
from mnemora.operators.numbering import numbered_within

MEMORY_SORTS = ["created_at", "event_time", "importance_score", "last_accessed_at", "access_frequency"]
ENTITY_SORTS = ["name", "created_at", "degree"]


def filtered(df: DataFrame, **equals) -> DataFrame:
    """Rows that fit all filters that are given; None stands for no filter."""
    tests = [F.col(k) == v for k, v in equals.items() if v is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def name_like(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Case-insensitive substring; % and _ of the user are wildcards."""
    return df.where(F.col(column).ilike(f"%{text}%"))


def ordered(sort: str, descending: bool) -> Column:
    """Nulls first in descending order, last in ascending order."""
    return F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()


def page(df: DataFrame, sort: str, key: str, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    tie = F.col(key).desc() if descending else F.col(key).asc()
    return df.orderBy(ordered(sort, descending), tie).offset(offset).limit(limit)


def offset_page(df: DataFrame, sort: str, key: str, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page with next_offset, null on the last page."""
    tie = F.col(key).desc() if descending else F.col(key).asc()
    taken = page(df, sort, key, descending, limit + 1, offset).withColumn("n_", F.row_number().over(W.orderBy(ordered(sort, descending), tie)))
    more = F.max("n_").over(W.partitionBy()) > limit
    return taken.withColumn("next_offset", F.when(more, offset + limit).cast("long")).where(F.col("n_") <= limit).drop("n_")


def list_memories(memories: DataFrame, sort: str = "created_at", descending: bool = True, limit: int = 50, offset: int = 0, memory_type: str | None = None) -> DataFrame:
    if sort not in MEMORY_SORTS:
        raise ValueError(f"sort: one of {MEMORY_SORTS}")
    if not 1 <= limit <= 500:
        raise ValueError("limit: 1 to 500")
    return page(filtered(memories, memory_type=memory_type), sort, "memory_id", descending, limit, offset)


def list_entities(entities: DataFrame, q: str | None = None, entity_type: str | None = None, sort: str = "name", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    if sort not in ENTITY_SORTS:
        raise ValueError(f"sort: one of {ENTITY_SORTS}")
    rows = filtered(entities, entity_type=entity_type)
    return page(name_like(rows, q) if q else rows, sort, "entity_id", descending, limit, offset)


def keyset_page(df: DataFrame, at: str, key: str, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """The rows behind a cursor in order of (at, key), with the cursor of each and whether more follow the page."""
    rows = df
    if after is not None:
        rows = df.where((F.col(at) > F.lit(after[0])) | ((F.col(at) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    taken = rows.orderBy(at, key).limit(limit + 1).withColumn("n_", F.row_number().over(W.orderBy(at, key)))
    more = F.max("n_").over(W.partitionBy()) > limit
    return taken.withColumns({"has_more": more, "cursor": encode_cursor(F.col(at), F.col(key))}).where(F.col("n_") <= limit).drop("n_")


def feed(df: DataFrame, key: str, before: int | None = None, limit: int = 50) -> DataFrame:
    """Newest first, older than `before`."""
    rows = df if before is None else df.where(F.col(key) < before)
    return rows.orderBy(F.desc(key)).limit(limit)


def oldest_first(df: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(at, key).limit(limit)


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def earliest_membership(members: DataFrame, groups: DataFrame) -> DataFrame:
    return first_per_key(members.join(groups, "group_id"), ["user_id"], "joined_at", "group_id")


def with_owner_names(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Names of the owners; the user table is cut to the owners met before it is joined."""
    owners = users.join(rows.select(F.col("owner_user_id").alias("user_id")).distinct(), "user_id", "left_semi").select(F.col("user_id").alias("owner_user_id"), F.col("name").alias("owner_name"))
    return rows.join(owners, "owner_user_id", "left")


def in_batches(df: DataFrame, keys: list[str], order: list[str], size: int = 10) -> DataFrame:
    """Numbers each key's rows into batches of `size`; the rows of one key are spread over tasks."""
    numbered = numbered_within(df, keys, order, "n_", "all_")
    return numbered.withColumn("batch_no", F.expr(f"n_ div {size}")).drop("n_", "all_")


def keyset_pages(df: DataFrame, at: str, key: str, limit: int = 5000) -> DataFrame:
    """(page, rows, first and last cursor) of all pages that a scan in order of (at, key) reads one after the other."""
    numbered = numbered_within(df.select(F.lit(0).alias("all"), at, key), ["all"], [at, key], "n_", "size_").withColumn("page", F.expr(f"n_ div {limit}"))
    edge = F.struct(at, key)
    pages = numbered.groupBy("page").agg(F.count("*").alias("rows"), F.min(edge).alias("first"), F.max(edge).alias("last"))
    return pages.select("page", "rows", encode_cursor(F.col(f"first.{at}"), F.col(f"first.{key}")).alias("first_cursor"), encode_cursor(F.col(f"last.{at}"), F.col(f"last.{key}")).alias("last_cursor"))


def key_list(keys: DataFrame, spaces: DataFrame) -> DataFrame:
    """API keys with the name of the space they are bound to, if they are."""
    return keys.join(spaces.select("space_id", F.col("name").alias("space")), "space_id", "left")


def invite_list(invites: DataFrame, orgs: DataFrame, users: DataFrame) -> DataFrame:
    """Invites with the organisation's name and the name of who sent them."""
    named = invites.join(orgs.select("org_id", F.col("name").alias("org")), "org_id")
    return named.join(users.select(F.col("user_id").alias("invited_by"), F.col("name").alias("inviter")), "invited_by")
