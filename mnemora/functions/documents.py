"""JSON expressions: metadata that is kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "map<string,string>"


def field(meta: Column, key: str) -> Column:
    return F.get_json_object(meta, f"$.{key}")


def int_field(meta: Column, key: str) -> Column:
    return F.coalesce(field(meta, key).try_cast("long"), F.lit(0))


def string_field(meta: Column, key: str) -> Column:
    """Only where the value is a JSON string, not a number or an object."""
    return F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(meta), f"$.{key}", "variant")) == "STRING", field(meta, key))


def as_map(meta: Column) -> Column:
    """Top-level fields; what is null or no object counts as empty."""
    return F.coalesce(F.from_json(meta, STRINGS), F.create_map().cast(STRINGS))


def merged(meta: Column, **fields: Column) -> Column:
    new = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    keys = F.map_keys(new)
    return F.to_json(F.map_concat(F.map_filter(as_map(meta), lambda k, _: ~F.array_contains(keys, k)), new))


def without(meta: Column, *keys: str) -> Column:
    return F.to_json(F.map_filter(as_map(meta), lambda k, _: ~k.isin(*keys)))


def contains_id(ids: Column, wanted: Column) -> Column:
    """Whether a JSON array of numbers holds the id."""
    return F.coalesce(F.array_contains(F.from_json(ids, "array<long>"), wanted), F.lit(False))


def entitlements(defaults: Column, overrides: Column, grant: Column) -> Column:
    """Limits of a plan: an active grant's plan, else the defaults, with the overrides on top."""
    base = F.coalesce(grant, defaults)
    extra = as_map(overrides)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extra), k)), extra)


def log_record(raw: Column, schema: str) -> Column:
    """A record that is an object in a log line, or a string that holds one."""
    inner = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
    return F.from_json(F.when(F.ltrim(raw).startswith('"'), inner).otherwise(raw), schema)
