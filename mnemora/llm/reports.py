"""The registered queries of the filter audit, the manifest and the chat formatting, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.llm.chat import chat_report
from mnemora.llm.common import table
from mnemora.llm.filters import filter_audit
from mnemora.llm.merkle import dataset_manifest

ODD_CHAT = r"\### Assistant: </turn> ok"


def op11_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark, sf_dir):
    return dataset_manifest(table(spark, sf_dir, "documents"))


def op13_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ODD_CHAT).alias("text"))
    return chat_report(rows.unionByName(odd)).drop("n_loss")


QUERIES = {"op11_filter_audit": op11_filter_audit, "op12_merkle_manifest": op12_merkle_manifest, "op13_chat_format": op13_chat_format}

_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
# the checksum bit by bit, of a number's decimal digits
_CRC32 = """xor(4294967295::bigint, list_reduce(list_transform(range(1, length({0}::varchar) + 1), lambda j: ord(({0}::varchar)[j])::bigint), lambda crc, b: list_reduce(range(0, 8), lambda x, j: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, xor(crc, b)), 4294967295::bigint))"""
ORACLE_SQL: dict[str, str] = {
    # every document goes through every order and is dropped by the first filter that it fails
    "op11_filter_audit": rf"""with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
worded as (select *, {_WORDS} as w, coalesce(min(doc_id) over (partition by t) < doc_id, false) as again from texts),
failed as (select part, case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end
  || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when again then 'E' else '' end as f, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from worded left join marks using (doc_id)),
grouped as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
stepped as (select part, o as filter_order, k::integer as step, f, n, good, toxic, contains(f, o[k]) as fails, len(list_filter(range(1, k), lambda i: contains(f, o[i]))) > 0 as gone, o[k] = f as alone, o[k] as letter from grouped, orders, range(1, 6) r(k)),
summed as (select part, filter_order, step, any_value(letter) as letter, sum(n) filter (not fails and not gone) as kept, sum(n) filter (fails and not gone) as removed, sum(n) filter (fails and gone) as redundant,
  sum(n) filter (alone) as unique_fails, sum(good) filter (fails and not gone) as good_lost, sum(toxic) filter (fails and not gone) as toxic_lost from stepped group by 1, 2, 3)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, letter))::bigint as shapley from summed""",
    "op12_merkle_manifest": rf"""with recursive fields as (select *, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
leaves as (select doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf, sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) as changed from fields),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, case when lang is null then '' else '=' || lang end as g from leaves),
tree(g, k, nodes) as (select g, 0, list(leaf order by i) from placed group by g
  union all select g, k + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda j: sha256(array_to_string(nodes[j * 8 + 1 : j * 8 + 8], ''))) from tree where len(nodes) > 1),
subroots as (select g, row_number() over (order by g) - 1 as i, nodes[1] as subroot, k as depth from tree where len(nodes) = 1),
top(k, nodes) as (select 0, list(subroot order by i) from subroots union all select k + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda j: sha256(array_to_string(nodes[j * 8 + 1 : j * 8 + 8], ''))) from top where len(nodes) > 1),
started as (select doc_id, p.g, p.i, s.i as up, s.depth, leaf, case when coalesce({_CRC32.format('doc_id')} % 3 = 0, false) then changed else leaf end as held, subroot from placed p join subroots s using (g)),
folded(doc_id, leaf, subroot, g, i, up, depth, k, acc, proof) as (select doc_id, leaf, subroot, g, i, up, depth, 0, held, '' from started
  union all select f.doc_id, f.leaf, f.subroot, f.g, f.i, f.up, f.depth, f.k + 1, sha256(array_to_string(n.l[: n.p], '') || f.acc || array_to_string(n.l[n.p + 2 :], '')), f.proof || array_to_string(n.l[: n.p], '') || array_to_string(n.l[n.p + 2 :], '')
  from folded f join (select g, k, nodes from tree where len(nodes) > 1 union all select '*', k, nodes from top where len(nodes) > 1) t
    on t.g = case when f.k < f.depth then f.g else '*' end and t.k = case when f.k < f.depth then f.k else f.k - f.depth end,
  lateral (select case when f.k < f.depth then f.i // (8 ** f.k)::bigint else f.up // (8 ** (f.k - f.depth))::bigint end as here), lateral (select here % 8 as p, t.nodes[here // 8 * 8 + 1 : here // 8 * 8 + 8] as l) n),
ended as (select *, (select max(k) from top) as height from folded)
select doc_id, leaf, subroot, (select nodes[1] from top where len(nodes) = 1) as root, sha256(proof) as proof_sha256, acc as folded_root, acc = (select nodes[1] from top where len(nodes) = 1) as verified from ended where k = depth + height""",
    "op13_chat_format": r"""with asked as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (select *, role is not distinct from lag(role) over (partition by conv_id order by turn nulls first, role, text) as goes_on from asked),
shown as (select *, regexp_replace(replace(replace(text, '\', '\\'), '</', '<\/'), '##', '#\\#', 'g') as once, replace(regexp_replace(replace(replace(role, '\', '\\'), '</', '<\/'), '##', '#\\#', 'g'), ':', '\:') as head from marked)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(regexp_replace(once, '##', '#\\#', 'g')) + case when goes_on then 7 else 14 + length(head) end)::bigint as formatted_chars from shown group by 1""",
}
