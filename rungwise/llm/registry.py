"""Registered queries of the text operators: name -> (query, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm import (
    bpe,
    editcount,
    langid,
    mix,
    packing,
    parity,
    pii,
    quality,
    ranked,
    rpforest,
    toxicity,
    variants,
    warc,
)
from rungwise.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back."""
    pages = table(spark, sf_dir, "pages")
    return warc.read(warc.write(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return rpforest.linked(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return parity.classes(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix.takes(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.score(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits derived from it."""
    ranks = public_tokenizers.path(bpe.RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", editcount.derived_edits().alias("edits"))
    return editcount.apply(editcount.build(docs, ranks), "edits", ranks).select(
        "doc_id", "n_tokens_before", "n_tokens", "encoded_chars", F.length("text").cast("long").alias("n_chars")
    )


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return variants.group(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(bpe.RANKS))


OP2_SQL = """
with p as (
  select page_id, coalesce(html, '') as t from pages
), q as (
  select page_id, octet_length(encode(t)) as payload_bytes, sha1(t) as payload_digest from p
), g as (
  select payload_digest as d, max(page_id) as top from q where payload_bytes >= 1000 group by 1
)
select page_id, payload_bytes, payload_digest,
       case when top is null or page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id <> top then top end as refers_to
from q left join g on payload_digest = d and payload_bytes >= 1000
"""

OP7_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select distinct doc_id, unnest(
    case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
         else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh
  from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as k
  from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all
), l as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y
  where 100 * k >= 75 * (a.n + b.n - k)
), e as (
  select x, y from l union all select y, x from l
), r as (
  select doc_id as id, doc_id as c from documents
  union
  select r.id, e.y from r join e on r.c = e.x
)
select r.id as doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(c) as component_id
from r left join n on n.doc_id = r.id group by r.id
"""

OP11_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents
), h as (
  select r, doc_id, len(ts)::bigint as n from d where len(ts) > 0
), s as (
  select count(*)::bigint as docs, sum(n)::bigint as terms from h
), p as (
  select r, t, count(*)::bigint as tf from (select r, unnest(ts) as t from d) group by all
), i as (
  select q, item_id, t, count(*)::bigint as times from (
    select row_number() over () as q, item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
    from benchmark
  ) group by all
), w as (
  select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from p, s where t in (select t from i) group by t, docs
), m as (
  select r, doc_id, 25 + (75 * n * docs) // terms as m from h, s
), c as (
  select q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from i join w using (t) join p using (t) join m using (r) group by all
)
select item_id, k::int as rank, doc_id, score from (
  select *, row_number() over (partition by q order by score desc, doc_id nulls last) as k from c where score > 0
) where k <= 10
"""

QUERIES = {
    "op1_byte_bpe": (op1_byte_bpe, None),
    "op2_warc": (op2_warc, OP2_SQL),
    "op3_personal_data": (op3_personal_data, None),
    "op4_language": (op4_language, None),
    "op5_vector_forest": (op5_vector_forest, None),
    "op6_quality": (op6_quality, None),
    "op7_parity_join": (op7_parity_join, OP7_SQL),
    "op8_mix": (op8_mix, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_edit_counts": (op10_edit_counts, None),
    "op11_ranked": (op11_ranked, OP11_SQL),
    "op12_variants": (op12_variants, None),
    "op13_packing": (op13_packing, None),
}
