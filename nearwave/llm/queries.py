"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearwave.llm.common import table
from nearwave.llm.compression_rules import quality_rules
from nearwave.llm.decontaminate import leaks
from nearwave.llm.hard_negatives import hard_negatives
from nearwave.llm.line_dedup import line_report
from nearwave.llm.ordinal_quality import quality_classifier
from nearwave.llm.piece_sampling import piece_digest
from nearwave.llm.pii import personal_data, span_digest
from nearwave.llm.ranked_search import ranked_search
from nearwave.llm.simhash_dedup import near_duplicates
from nearwave.llm.tag_paths import main_texts
from nearwave.llm.token_file import token_digest
from nearwave.llm.toxicity import toxicity
from nearwave.llm.warc import archive_round_trip


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(personal_data(table(spark, sf_dir, "documents")))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op8_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = (
    op1_decontamination,
    op2_compression_rules,
    op3_piece_sampling,
    op4_simhash_dedup,
    op5_ordinal_quality,
    op6_pii,
    op7_warc_index,
    op8_tag_paths,
    op9_token_file,
    op10_line_dedup,
    op11_hard_negatives,
    op12_toxicity,
    op13_ranked_search,
)

#: Every window as long as an item that shares a shingle with it, compared by brute force.
OP1_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, text,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as words
  from documents),
b as (
  select row_number() over () as item, item_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as words
  from benchmark),
ds as (
  select r, pos, array_to_string(words[pos + 1 : pos + 5], ' ') as s
  from (select r, words, unnest(range(len(words) - 4)) as pos from d)),
bs as (
  select item, len(words) - 4 as m, array_to_string(words[k + 1 : k + 5], ' ') as s
  from (select item, words, unnest(range(len(words) - 4)) as k from b)),
hits as (select distinct r, pos, item, m from ds join bs using (s)),
windows as (
  select distinct r, item, m, start
  from (select r, item, m, pos - unnest(range(m)) as start from hits) join d using (r)
  where start >= 0 and start + m + 4 <= len(words)),
window_counts as (
  select w.r, item, m, start, s, count(*) as c
  from windows w join ds on ds.r = w.r and ds.pos between start and start + m - 1 group by all),
item_counts as (select item, s, count(*) as c from bs group by all),
common as (
  select w.r, item, m, start, sum(least(w.c, i.c)) as n
  from window_counts w join item_counts i using (item, s) group by all),
found as (
  select doc_id, text, item_id, start, m + 4 as n_words, n::double / (2 * m - n)::double as similarity
  from common join d using (r) join b using (item))
select doc_id, item_id, cast(start as bigint) as start, cast(n_words as bigint) as n_words, similarity
from found where similarity >= 0.8
qualify row_number() over (partition by doc_id, text, item_id order by similarity desc, start) = 1
"""

OP7_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as digest,
         octet_length(encode(coalesce(html, ''))) as n
  from pages),
first as (
  select digest, min(page_id) as first from p where n >= 100 group by digest having count(*) > 1)
select page_id, n as payload_bytes, p.digest as payload_digest,
       case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from p left join first on p.digest = first.digest
"""

OP10_SQL = """
with d as (
  select row_number() over () as r, doc_id, source, text from documents),
lines as (
  select r, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k
  from d where text is not null),
bare as (
  select *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as b from lines),
totals as (select source, count(*) as site_pages from documents group by source),
counts as (
  select source, b, count(distinct r) as pages from bare where b <> '' group by source, b),
bad as (
  select c.source, b from counts c join totals t on c.source is not distinct from t.source
  where pages - cast(1.645 as double) * sqrt(pages) > cast(0.05 as double) * site_pages),
marked as (
  select bare.*, bad.b is not null as dropped
  from bare left join bad on bare.source is not distinct from bad.source and bare.b = bad.b),
joined as (
  select r, sum(case when dropped then 1 else 0 end) as n_dropped, count(*) as n,
         coalesce(string_agg(line, chr(10) order by k) filter (where not dropped), '') as text
  from marked group by r)
select d.doc_id, d.source,
       cast(case when d.text is null then 0 when joined.text = '' then 1 else n - n_dropped end as bigint) as n_lines_left,
       cast(coalesce(n_dropped, 0) as bigint) as n_dropped,
       case when d.text is null then null else joined.text end as text
from d left join joined on d.r = joined.r
"""

#: Inner products of every anchor with every row.
OP11_SQL = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as integer) as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id,
         cast(list_inner_product(a.q, b.q) as bigint) as score
  from (select * from v where vec_id % 100 = 0) a join v b on a.vec_id <> b.vec_id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank,
       id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

#: Scores of all pairs of an item and a document that share a term.
OP13_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
q as (
  select distinct item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
corpus as (
  select cast(count(*) as bigint) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d where len(terms) > 0),
m as (
  select r, doc_id, 50 + (50 * len(terms) * n_docs) // n_terms as m from d, corpus where len(terms) > 0),
tf as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from d) where term in (select term from q) group by all),
w as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
  from tf, corpus group by term, n_docs),
scored as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from q join tf using (term) join w using (term) join m using (r) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank,
       doc_id, score
from scored where score > 0
qualify rank <= 50
"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def all_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op7_warc_index": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_ranked_search": OP13_SQL}
