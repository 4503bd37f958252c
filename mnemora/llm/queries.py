"""The registered queries of the corpus operators, with production parameters, and their oracles."""

from __future__ import annotations

from mnemora.llm import reports
from mnemora.llm.common import table
from mnemora.llm.decontamination import decontaminate
from mnemora.llm.lm import lm_scores
from mnemora.llm.ngram_join import ngram_jaccard_join
from mnemora.llm.packing import pack_documents
from mnemora.llm.pii import span_report
from mnemora.llm.quality import classify_quality
from mnemora.llm.suffix_dedup import remove_repeats
from mnemora.llm.tokenids import token_ids
from mnemora.llm.vector_dedup import near_duplicate_vectors
from mnemora.llm.warc import warc_round_trip


def op1_ngram_join(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark, sf_dir):
    return span_report(table(spark, sf_dir, "documents"))


def op5_vector_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality(spark, sf_dir):
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark, sf_dir):
    out = warc_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_token_ids(spark, sf_dir):
    return token_ids(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_ids": op9_token_ids,
    "op10_packing": op10_packing,
    **reports.QUERIES,
}
_BLANKS = r"[\x20\x09-\x0D]+"
_REACHED = "reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b)"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": rf"""with recursive worded as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}'), lambda w: w <> '') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from worded),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2) where 100 * c >= 80 * (na + nb - c)),
{_REACHED}
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce((select min(b) from reached where a = doc_id), doc_id)) as component_id from sets""",
    "op5_vector_dedup": f"""with recursive good as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACHED},
found as (select vec_id, (select count(*) from links where a = vec_id) as n_links, least(vec_id, coalesce((select min(b) from reached where a = vec_id), vec_id)) as component_id from embeddings)
select vec_id, n_links, component_id, vec_id = component_id as kept from found""",
    **reports.ORACLE_SQL,
}
