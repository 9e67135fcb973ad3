"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abaculus.llm import line_dedup, pii, sentencepiece_sampling, token_files, warc_zip
from abaculus.llm.decontaminate import decontaminate
from abaculus.llm.exact_dedup import exact_dedup
from abaculus.llm.hard_negatives import hard_negatives
from abaculus.llm.lang_id import language_id
from abaculus.llm.minhash import near_duplicates
from abaculus.llm.quality_rules import score_quality
from abaculus.llm.resampling import resample
from abaculus.llm.suffix_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"), with_payload=False).drop("url", "payload")


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.per_document(table(spark, sf_dir, "documents"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "ids_crc32", "lossless")


def op7_token_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("keep_locator")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return hard_negatives(embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_warc_zip,
        op3_pii_boosting,
        op4_fuzzy_lines,
        op5_rule_ensemble,
        op6_sentencepiece_sampling,
        op7_token_dictionary,
        op8_language_id,
        op9_exact_dedup,
        op10_winnowing,
        op11_hard_negatives,
        op12_suffix_merge,
        op13_importance_resampling,
    )
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_minhash_near_dedup": rf"""
with recursive w as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as g from s),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.g = y.g and x.doc_id <> y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on l.a = r.b)
select n.doc_id, n.n as n_shingles, min(r.b) as component_id, min(r.b) = n.doc_id as kept
from n join r on r.a = n.doc_id group by n.doc_id, n.n""",
    "op2_warc_zip": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as h from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by h) end as first_id from p)
select page_id, n as payload_bytes, h as payload_digest, case when page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when page_id <> first_id then first_id end as refers_to from f""",
    "op9_exact_dedup": f"""
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256({LOWER}) as text_sha256
from documents window g as (partition by {LOWER})""",
    "op10_winnowing": rf"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i+least(len(w), 10)-1], ' ') as win
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (select doc_id, k, i, array_to_string(w[i:i+k-1], ' ') as win
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw))),
h as (select doc_id, item_id, i, dw.k from dw join bw on dw.win = bw.win and dw.k = bw.k),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)""",
    "op11_hard_negatives": """
with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, r.id, a.label = r.label as same, list_inner_product(a.q, r.q)::bigint as score from e a join e r on a.id % 50 = 0 and a.id <> r.id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank, id as negative_id, positive_score, score as negative_score
      from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op12_suffix_merge": """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, i, b[i + 1:i + 50] as w from (select doc_id, b, unnest(range(0, octet_length(b) - 49)) as i from d)),
f as (select w, min(doc_id) as first_id from w group by w having min(doc_id) < max(doc_id)),
c as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as new from w join f using (w) where doc_id > first_id),
g as (select doc_id, i, count_if(new) over (partition by doc_id order by i) as n from c),
r as (select doc_id, min(i) as lo, max(i) + 50 as hi from g group by doc_id, n),
k as (select doc_id, lo, hi, hex(b[coalesce(lag(hi) over (partition by doc_id order by lo), 0) + 1:lo]) as piece from r join d using (doc_id)),
a as (select doc_id, sum(hi - lo)::bigint as n_removed, count(*) as n_spans, string_agg(piece, '' order by lo) as head, max(hi) as z from k group by doc_id)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(head, '') || coalesce(hex(b[coalesce(z, 0) + 1:octet_length(b)]), ''))) as kept_sha256
from d left join a using (doc_id)""",
    "op13_importance_resampling": rf"""
with t8 as materialized (select list(c order by i) as tab from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select unnest(range(256)) as i))),
w as (select 'd' as side, doc_id as id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
      union all select 'b', item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) as f from w),
c as (select side, id, f, count(*) as n from f group by all),
x as materialized (select f, hex(encode(f)) as h from (select distinct f from c)),
k as materialized (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i+1])::bigint)),
        lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket from x, t8),
n as (select bucket, sum(n) filter (side = 'b') as t, sum(n) filter (side = 'd') as s from c join k using (f) group by bucket),
g as (select b.bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (sum(s) over ()::double + 10000) / ((coalesce(s, 0)::double + 1) * (sum(t) over ()::double + 10000))))::bigint as gain
      from (select unnest(range(10000)) as bucket) b left join n on n.bucket = b.bucket),
d as (select id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from c join k using (f) join g using (bucket) where side = 'd' group by id),
s as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::bigint::double + 0.5) / 4294967296)))::bigint as score
      from documents left join d on id = doc_id),
r as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from s where n_features >= 39)
select doc_id, n_features, weight, score, case when r <= n * 25 // 100 then r end as rank from s left join r using (doc_id)""",
}
