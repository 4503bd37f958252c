"""The engine's tables, derived from the driver's: as DataFrames and, for the oracles, as DuckDB CTEs.

The rules are simple functions of the keys, so either side can state them on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.graph import GraphTables
from mnemora.operators.keyword import build_index
from mnemora.operators.scope import TenantScope
from mnemora.sources.stores import table

NOW = "2024-01-31 12:00:00"
GRAPH_NOW, AS_OF = "1998-06-01 00:00:00", "1998-01-01 00:00:00"
SPACES = 5
TODAY = datetime.fromisoformat(NOW)
SCOPE = TenantScope(org=1, space=2, visible=tuple(range(0, 25)))
SCOPE_SQL = "org_id = 1 and space_id = 2 and (visibility = 'org' or owner_user_id < 25)"


def at(text: str = NOW):
    return F.lit(text).cast("timestamp")


def hours(start: str, n):
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + n * 3600)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    quality = table(spark, sf_dir, "labels", "doc_id", "quality")
    i = F.col("doc_id")
    recorded = hours("2023-01-02", i * 37 % 9000)
    kind = F.when(F.col("lang") == "en", "fact").when(F.col("lang") == "fr", "preference").otherwise("event")
    return d.join(quality, "doc_id", "left").select(
        i.alias("memory_id"),
        F.lit(1).alias("org_id"),
        (i % SPACES).alias("space_id"),
        (i % 50).alias("owner_user_id"),
        F.when(i % 3 == 0, "org").otherwise("private").alias("visibility"),
        F.coalesce("text", F.lit("")).alias("content"),
        kind.alias("memory_type"),
        F.col("quality").cast("double").alias("importance_score"),
        F.when(i % 5 != 0, hours("2023-01-01", i * 37 % 9000)).alias("event_time"),
        recorded.alias("recorded_at"),
        recorded.alias("created_at"),
        hours("2023-01-02", i * 37 % 9000 + i % 30).alias("last_accessed_at"),
        (i % 11).alias("access_frequency"),
        F.when(i % 17 == 0, at()).alias("forgotten_at"),
    )


_INDEXES: dict[tuple[str, str], DataFrame] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories' keyword index, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        _INDEXES[key] = build_index(table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("memory_id"), F.coalesce("text", F.lit("")).alias("content")))
    return _INDEXES[key]


MEMORIES = """memories as (select d.doc_id as memory_id, 1 as org_id, d.doc_id % 5 as space_id, d.doc_id % 50 as owner_user_id,
  case when d.doc_id % 3 = 0 then 'org' else 'private' end as visibility, coalesce(d.text, '') as content,
  case d.lang when 'en' then 'fact' when 'fr' then 'preference' else 'event' end as memory_type, l.quality::double as importance_score,
  case when d.doc_id % 5 <> 0 then timestamp '2023-01-01' + to_hours(d.doc_id * 37 % 9000) end as event_time,
  timestamp '2023-01-02' + to_hours(d.doc_id * 37 % 9000) as recorded_at, timestamp '2023-01-02' + to_hours(d.doc_id * 37 % 9000) as created_at,
  timestamp '2023-01-02' + to_hours(d.doc_id * 37 % 9000 + d.doc_id % 30) as last_accessed_at, d.doc_id % 11 as access_frequency,
  case when d.doc_id % 17 = 0 then timestamp '2024-01-31 12:00:00' end as forgotten_at
  from documents d left join labels l using (doc_id)),
seen as (select * from memories where org_id = 1 and space_id = 2 and (visibility = 'org' or owner_user_id < 25) and forgotten_at is null)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per document, in various states; its chunks are four to a source, some missing."""
    i = F.col("doc_id")
    status = F.when(i % 10 < 7, "completed").when(i % 10 == 7, "failed").when(i % 10 == 8, "processing").otherwise("pending")
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang").select(
        i.alias("source_id"),
        F.lit(1).alias("org_id"),
        (i % SPACES).alias("space_id"),
        F.when(i % 23 != 0, i % 50).alias("owner_user_id"),
        F.when(i % 2 == 0, "text").otherwise("markdown").alias("content_type"),
        F.coalesce("text", F.lit("")).alias("content"),
        status.alias("status"),
        F.when(i % 4 == 0, F.concat(F.lit("s"), (i % 40).cast("string"))).alias("session_id"),
        F.ceil(F.length("text") / 4).alias("token_count"),
        hours("2024-01-01", i % 700).alias("created_at"),
        hours("2024-01-01", i % 700 + 1).alias("updated_at"),
        (i % 7).alias("attempts"),
        F.to_json(F.struct((i % 6).alias("ingest_next_sequence"))).alias("meta"),
    )


SOURCES = """sources as (select doc_id as source_id, 1 as org_id, doc_id % 5 as space_id, case when doc_id % 23 <> 0 then doc_id % 50 end as owner_user_id,
  case when doc_id % 2 = 0 then 'text' else 'markdown' end as content_type, coalesce(text, '') as content,
  case when doc_id % 10 < 7 then 'completed' when doc_id % 10 = 7 then 'failed' when doc_id % 10 = 8 then 'processing' else 'pending' end as status,
  case when doc_id % 4 = 0 then 's' || (doc_id % 40) end as session_id, ceil(length(text) / 4)::bigint as token_count,
  timestamp '2024-01-01' + to_hours(doc_id % 700) as created_at, timestamp '2024-01-01' + to_hours(doc_id % 700 + 1) as updated_at,
  doc_id % 7 as attempts, doc_id % 6 as mark from documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four windows a source, none for every 13th, and every 9th lacks its third."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents", "doc_id").where(i % 13 != 0).select(i.alias("source_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("sequence"))
    rows = rows.where(~((F.col("source_id") % 9 == 0) & (F.col("sequence") == 2)))
    return rows.select((F.col("source_id") * 4 + F.col("sequence")).alias("chunk_id"), "source_id", "sequence")


CHUNKS = """chunks as (select doc_id * 4 + s as chunk_id, doc_id as source_id, s as sequence from documents, range(4) r(s)
  where doc_id % 13 <> 0 and not (doc_id % 9 = 0 and s = 2))"""


def chunk_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory comes from the first chunk of its own source and the second of another's; every 19th from none."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents", "doc_id").where(i % 19 != 0)
    return d.select(F.explode(F.array(i * 4, F.floor(i / 2) * 4 + 1)).alias("chunk_id"), i.alias("memory_id"))


CHUNK_MEMORIES = """chunk_memories as (select doc_id * 4 as chunk_id, doc_id as memory_id from documents where doc_id % 19 <> 0
  union all select (doc_id // 2) * 4 + 1, doc_id from documents where doc_id % 19 <> 0)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, suppliers, parts and customers, told apart by the range of their ids."""
    parts = [
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("name"), F.lit("location").alias("entity_type")),
        table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10**9).alias("entity_id"), F.col("s_name").alias("name"), F.lit("organization").alias("entity_type")),
        table(spark, sf_dir, "part").select((F.col("p_partkey") + 2 * 10**9).alias("entity_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 5, "object").alias("entity_type")),
        table(spark, sf_dir, "customer").select((F.col("c_custkey") + 3 * 10**9).alias("entity_id"), F.col("c_name").alias("name"), F.lit("person").alias("entity_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"org_id": F.lit(1), "space_id": F.lit(2)})


ENTITIES = """entities as (select n_nationkey::bigint as entity_id, n_name as name, 'location' as entity_type, 1 as org_id, 2 as space_id from nation
  union all select s_suppkey + 1000000000, s_name, 'organization', 1, 2 from supplier
  union all select p_partkey + 2000000000, p_name, case when p_size > 5 then 'object' end, 1, 2 from part
  union all select c_custkey + 3000000000, c_name, 'person', 1, 2 from customer)"""


# the cosine of each asked key and each entity, over all grams that they share
ALIKE = r"""framed as (select entity_id, ' ' || trim(regexp_replace(lower(name), '\s+', ' ', 'g')) || ' ' as f from entities where trim(name) <> ''),
cut as (select entity_id, unnest(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3))) as g from framed),
rarity as (select g, ln(1 + (select count(*) from framed) / count(distinct entity_id)) as idf from cut group by 1),
weighed as (select entity_id, g, count(*) * any_value(idf) as w from cut join rarity using (g) group by 1, 2),
sizes as (select entity_id, sqrt(sum(w * w)) as size from weighed group by 1),
asked_cut as (select key, unnest(list_transform(range(1, length(key) + 1), lambda i: substr(' ' || key || ' ', i, 3))) as g from asked),
asked_weighed as (select key, g, count(*) * coalesce(any_value(idf), ln(1 + (select count(*) from framed))) as w from asked_cut left join rarity using (g) group by 1, 2),
asked_sizes as (select key, sqrt(sum(w * w)) as size from asked_weighed group by 1),
alike as (select key, entity_id, sum(a.w * b.w) / any_value(s.size) / any_value(t.size) as cosine from asked_weighed a join weighed b using (g) join asked_sizes s using (key) join sizes t using (entity_id) group by 1, 2)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who supplies what (a line item each; equal ones are one edge), and where suppliers and customers are.

    Ids are 60 bits of an MD5 of the edge's own values.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice"), cents("l_discount"), cents("l_quantity"), "l_returnflag", F.date_format("l_shipdate", "yyyyMMdd"))
    ident = lambda k: F.conv(F.substring(F.md5(k), 1, 15), 16, 10).cast("long")
    n = F.col("l_linenumber")
    supplies = li.select(
        ident(key).alias("edge_id"),
        (F.col("l_suppkey") + 10**9).alias("source_id"),
        (F.col("l_partkey") + 2 * 10**9).alias("target_id"),
        F.lit("SUPPLIES").alias("relation_type"),
        F.when(n != 7, 1 - 8 * F.col("l_discount")).alias("confidence"),
        F.when(n != 6, F.col("l_shipdate").cast("timestamp")).alias("valid_from"),
        F.col("l_shipdate").cast("timestamp").alias("recorded_at"),
        F.when((F.col("l_returnflag") == "A") & (n == 1), at(GRAPH_NOW)).alias("forgotten_at"),
        (F.col("l_orderkey") % 1000).alias("memory_id"),
        F.when(n != 5, F.col("l_orderkey") % 50).alias("owner_user_id"),
    ).distinct()

    def located(name: str, key: str, nation: str, base: int) -> DataFrame:
        k = F.col(key)
        return table(spark, sf_dir, name, key, nation).select(
            ident(F.concat_ws("-", F.lit(name), k)).alias("edge_id"), (k + base).alias("source_id"), F.col(nation).cast("long").alias("target_id"), F.lit("LOCATED_IN").alias("relation_type"),
            F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("timestamp").alias("valid_from"), at("1995-01-01").alias("recorded_at"), F.lit(None).cast("timestamp").alias("forgotten_at"),
            F.lit(None).cast("long").alias("memory_id"), F.lit(None).cast("long").alias("owner_user_id"),
        )

    out = supplies.unionByName(located("supplier", "s_suppkey", "s_nationkey", 10**9)).unionByName(located("customer", "c_custkey", "c_nationkey", 3 * 10**9))
    return out.withColumns({"org_id": F.lit(1), "space_id": F.lit(2), "visibility": F.lit("private")})


_ID = "('0x' || substr(md5({}), 1, 15))::bigint"
EDGES = f"""edges as (select *, 1 as org_id, 2 as space_id, 'private' as visibility from (
  select distinct {_ID.format("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::bigint, round(l_discount * 100)::bigint, round(l_quantity * 100)::bigint, l_returnflag, strftime(l_shipdate, '%Y%m%d'))")} as edge_id,
    l_suppkey + 1000000000 as source_id, l_partkey + 2000000000 as target_id, 'SUPPLIES' as relation_type,
    case when l_linenumber <> 7 then 1 - 8 * l_discount end as confidence, case when l_linenumber <> 6 then l_shipdate end as valid_from, l_shipdate as recorded_at,
    case when l_returnflag = 'A' and l_linenumber = 1 then timestamp '{GRAPH_NOW}' end as forgotten_at, l_orderkey % 1000 as memory_id,
    case when l_linenumber <> 5 then l_orderkey % 50 end as owner_user_id from lineitem
  union all select {_ID.format("concat_ws('-', 'supplier', s_suppkey)")}, s_suppkey + 1000000000, s_nationkey::bigint, 'LOCATED_IN', null, null, timestamp '1995-01-01', null, null, null from supplier
  union all select {_ID.format("concat_ws('-', 'customer', c_custkey)")}, c_custkey + 3000000000, c_nationkey::bigint, 'LOCATED_IN', null, null, timestamp '1995-01-01', null, null, null from customer) e),
usable as (select *, coalesce(valid_from, recorded_at) as since from edges where org_id = 1 and space_id = 2 and (visibility = 'org' or owner_user_id < 25 or owner_user_id is null)
  and forgotten_at is null and coalesce(confidence, 1) >= 0.3 and coalesce(valid_from, recorded_at) <= timestamp '{AS_OF}')"""


def memory_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents", "doc_id")
    return d.select(i.alias("memory_id"), F.explode(F.array(i % 10 + 10**9, i % 200 + 2 * 10**9)).alias("entity_id"))


MEMORY_ENTITIES = """memory_entities as (select doc_id as memory_id, doc_id % 10 + 1000000000 as entity_id from documents
  union all select doc_id, doc_id % 200 + 2000000000 from documents)"""


def graph_tables(spark: SparkSession, sf_dir: str) -> GraphTables:
    return GraphTables(memories(spark, sf_dir), entities(spark, sf_dir), edges(spark, sf_dir), memory_entities(spark, sf_dir))


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space for each region; two have been deleted."""
    i = F.col("r_regionkey").cast("long")
    return table(spark, sf_dir, "region", "r_regionkey").select(i.alias("space_id"), F.concat(F.lit("space "), i.cast("string")).alias("name"), F.when(i == 3, at("2023-12-01")).when(i == 4, at("2024-01-20")).alias("deleted_at"))


SPACES_SQL = "spaces as (select r_regionkey::bigint as space_id, 'space ' || r_regionkey as name, case r_regionkey when 3 then timestamp '2023-12-01' when 4 then timestamp '2024-01-20' end as deleted_at from region)"


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as usage counters; its amounts are whole."""
    e = table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value")
    n = lambda kind, x: F.sum(F.when(F.col("event_type") == kind, x).otherwise(0)).cast("long")
    g = e.groupBy(F.lit(1).alias("org_id"), "user_id", (F.col("user_id") % SPACES).alias("space_id"), F.to_date("ts").alias("date"))
    return g.agg(n("signup", 1).alias("sources_ingested"), n("error", 1).alias("sources_failed"), n("purchase", 1).alias("memories_created"), n("click", F.floor("value")).alias("tokens_ingested"), n("view", 1).alias("search_queries"))


DAILY = """daily as (select 1 as org_id, user_id, user_id % 5 as space_id, ts::date as date, count(*) filter (event_type = 'signup') as sources_ingested,
  count(*) filter (event_type = 'error') as sources_failed, count(*) filter (event_type = 'purchase') as memories_created,
  coalesce(sum(floor(value)) filter (event_type = 'click'), 0)::bigint as tokens_ingested, count(*) filter (event_type = 'view') as search_queries from events group by 1, 2, 3, 4)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    return e.select(i, "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.concat(F.lit("v"), (i % 2).cast("string")).alias("version"), "value", (1 + i % 4).alias("weight"), F.when(F.col("event_type") == "error", F.when(i % 3 == 0, 429).otherwise(503)).otherwise(200).alias("status"))


METRICS = """metrics as (select event_id, user_id, ts, event_type as stage, 'v' || (event_id % 2) as version, value, 1 + event_id % 4 as weight,
  case when event_type = 'error' then case when event_id % 3 = 0 then 429 else 503 end else 200 end as status from events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    created = F.timestamp_seconds(F.unix_timestamp(at()) - i % 3000)
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        i.alias("job_id"), (F.col("o_custkey") % SPACES).alias("space_id"), (F.col("o_custkey") % 50).alias("owner_user_id"), status.alias("status"), created.alias("created_at"),
        F.timestamp_seconds(F.unix_timestamp(created) + 5).alias("started_at"), F.timestamp_seconds(F.unix_timestamp(created) + 5 + i % 90).alias("completed_at"),
    )


JOBS = """jobs as (select o_orderkey as job_id, o_custkey % 5 as space_id, o_custkey % 50 as owner_user_id,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'processing' end as status, timestamp '2024-01-31 12:00:00' - to_seconds(o_orderkey % 3000) as created_at,
  timestamp '2024-01-31 12:00:00' - to_seconds(o_orderkey % 3000) + to_seconds(5) as started_at,
  timestamp '2024-01-31 12:00:00' - to_seconds(o_orderkey % 3000) + to_seconds(5 + o_orderkey % 90) as completed_at from orders)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("group_id"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of five groups: each sees the next."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation", "n_nationkey").where(n % 5 != 4).select(n.alias("viewer_group"), (n + 1).alias("subject_group"))


GROUPS = """members as (select c_custkey as user_id, c_nationkey::bigint as group_id from customer),
grants as (select n_nationkey::bigint as viewer_group, n_nationkey::bigint + 1 as subject_group from nation where n_nationkey % 5 <> 4)"""


def oracle(*ctes: str) -> Callable[[str], str]:
    """Puts the derived tables in front of a query; `with recursive` allows closures."""
    return lambda body: "with recursive " + ",\n".join(ctes) + "\n" + body
