"""The registered queries of this folder, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmine.llm import decontam, fingerprints, html_density, langid, licenses, minhash, ngram_lm, packing, suffix_dedup, warc, word_queries
from specmine.llm.common import crc_mod, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    parts = packing.token_pieces(docs, tokenizer_path(), with_ids=False)
    return packing.pack(parts, packing.most_pieces(docs))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_hits(docs, read(spark, sf_dir, "benchmark"))
    items = F.array_sort("_hits.items")
    return found.select("doc_id", F.col("_hits.n_words").alias("n_words"), decontam.n_hit().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("_k", "_rank", "_root")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    pages = warc.mark_revisits(read(spark, sf_dir, "pages").select("page_id", "url", "html"), id_col="page_id", payload_col="html")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    records = pages.select(
        F.coalesce(name("page_id"), F.lit("<urn:page:>")).alias("record_id"),
        F.when(F.col("_original").isNull(), "response").otherwise("revisit").alias("type"),
        F.col("url").alias("target_uri"),
        F.lit("2020-01-01T00:00:00Z").alias("date"),
        name("_original").alias("refers_to"),
        F.col("html").cast("binary").alias("payload"),
    )
    path = f"{shared_dir(spark)}/specmine-warc-{uuid.uuid4().hex}"
    records.write.format("warc").mode("append").option("path", path).save()
    back = warc.read_archive(spark, path, payloads=["response"])
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    size = F.when(F.col("type") == "response", F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes"))
    return back.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    model = ngram_lm.train(docs.where(~held_out))
    return ngram_lm.score(docs.withColumn("held_out", held_out), model)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_density.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("licenses").cast("long").alias("n_licenses"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    sample = langid.sample_by_language(docs, learn=~held_out)
    out = langid.identify(docs.select("doc_id", "text"), sample)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


OP4_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct n from windows),
doc_windows as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)),
found as (select doc_id, i, n, item from doc_windows join windows using (n, win)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from found)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hits using (doc_id) left join named using (doc_id)
"""

OP5_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from inter join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
edges as (select a as u, b as v from links union select b, a from links),
reach as (select doc_id as u, doc_id as v from documents union select reach.u, edges.v from reach join edges on reach.v = edges.u)
select documents.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, documents.doc_id = component_id as kept
from documents left join sizes using (doc_id) join (select u as doc_id, min(v) as component_id from reach group by u) using (doc_id)
"""


OP6_SQL = r"""
with digests as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
parts as (select *, list_transform(range(0, 8), lambda g: cast(concat('0x', substr(h, cast(5 * g + 1 as bigint), 5)) as integer)) as v from digests),
largest as (select h, max(page_id) as top from digests group by h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((v[i // 4 + 1] >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1 as bigint), 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from parts join largest using (h)
"""


def op9_sql() -> str:
    """The same split, normal form, table and rules as text for DuckDB."""
    known = ", ".join(f"('{s.replace('cc0', 'cc#')}', '{k}')" for k, s in licenses.SENTENCES.items())
    rules = ", ".join(f"('{name}', ',{',(.*,)?'.join(ids)},')" for name, ids in licenses.RULES)
    normal = "trim(regexp_replace(regexp_replace(lower(s), '[0-9]+([.][0-9]+)*', '#', 'g'), '[^a-z#]+', ' ', 'g'))"
    return rf"""
with known(s, id) as (values {known}), rules(license, pattern) as (values {rules}),
cut as (
  select doc_id, way, unnest(parts) as s, unnest(range(len(parts))) as i
  from (select doc_id, 'l' as way, regexp_split_to_array(coalesce(text, ''), '{licenses.BY_LINE}') as parts from documents
        union all select doc_id, 's', regexp_split_to_array(coalesce(text, ''), '{licenses.BY_SENTENCE}') from documents)),
ids as (
  select doc_id, way, string_agg(id, ',' order by i) as ids, count(*) as n
  from (select doc_id, way, i, {normal} as s from cut where regexp_matches(lower(s), '{licenses.CUES}')) join known using (s) group by doc_id, way),
names as (select doc_id, string_agg(license, ',' order by license) as licenses, count(*) as n from (select distinct doc_id, license from ids join rules on regexp_matches(concat(',', ids, ','), pattern)) group by doc_id)
select d.doc_id, coalesce(names.licenses, '') as licenses,
  case when coalesce(s.n, 0) > coalesce(l.n, 0) then s.ids else coalesce(l.ids, '') end as sentence_ids, cast(coalesce(names.n, 0) as bigint) as n_licenses
from documents d left join names on names.doc_id = d.doc_id
left join ids l on l.doc_id = d.doc_id and l.way = 'l' left join ids s on s.doc_id = d.doc_id and s.way = 's'
"""


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_fingerprints": op3_fingerprints,
        "op4_decontamination": op4_decontamination,
        "op5_minhash": op5_minhash,
        "op6_warc": op6_warc,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_html_extraction": op8_html_extraction,
        "op9_license_scan": op9_license_scan,
        "op10_language_id": op10_language_id,
        **word_queries.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op5_minhash": OP5_SQL, "op6_warc": OP6_SQL, "op9_license_scan": op9_sql(), **word_queries.ORACLES}
