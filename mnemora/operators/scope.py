"""Tenant scope: the predicate that every read of the engine carries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Visible-user lists up to this length are literals of the predicate; longer ones are DataFrames to join.
MOST_LITERALS = 1000


@dataclass(frozen=True)
class TenantScope:
    """org and space; visible: None for no per-user filter, else the users whose private rows are seen."""

    org: int
    space: int | None = None
    visible: tuple[int, ...] | None = None

    def tenant(self) -> Column:
        out = F.col("org_id") == self.org
        return out if self.space is None else out & (F.col("space_id") == self.space)

    def seen(self, ownerless: bool = False) -> Column:
        if self.visible is None:
            return F.lit(True)
        if not self.visible:
            return F.lit(False)
        if len(self.visible) > MOST_LITERALS:
            raise ValueError(f"more than {MOST_LITERALS} visible users: use visible_rows() with a DataFrame")
        out = (F.col("visibility") == "org") | F.col("owner_user_id").isin(*self.visible)
        return out | F.col("owner_user_id").isNull() if ownerless else out


def scoped(df: DataFrame, scope: TenantScope, kind: str = "memory") -> DataFrame:
    """kind: memory or edge (private rows by owner), graph_edge (ownerless ones too), entity (no owner)."""
    out = df.where(scope.tenant())
    return out if kind == "entity" else out.where(scope.seen(ownerless=kind == "graph_edge"))


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("forgotten_at").isNull())


def active_spaces(spaces: DataFrame, include_deleted: bool = False) -> DataFrame:
    return spaces if include_deleted else spaces.where(F.col("deleted_at").isNull())


def visible_rows(df: DataFrame, users: DataFrame) -> DataFrame:
    """The rows that a user list of any length sees: org-wide ones, and those of an owner on the list."""
    private = df.where(F.col("visibility") != "org").join(users.select(F.col("user_id").alias("owner_user_id")).distinct(), "owner_user_id", "left_semi")
    return df.where(F.col("visibility") == "org").unionByName(private)


RANK_COLUMNS = ["memory_id", "org_id", "space_id", "owner_user_id", "visibility", "content", "memory_type", "importance_score", "event_time", "recorded_at", "created_at", "last_accessed_at", "access_frequency"]


def hydrate(memories: DataFrame, ids: DataFrame, scope: TenantScope) -> DataFrame:
    """The ranking columns of the wanted memories that the scope sees and that aren't forgotten."""
    return active(scoped(memories, scope)).select(*RANK_COLUMNS).join(ids.select("memory_id").distinct(), "memory_id", "left_semi")
