"""Queries 11 to 13: repeated word passages, conversation repair, spelling variants; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmine.llm import debruijn, repair, variants


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op11_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the contract's damage: ``there`` is false for dropped rows, ``copy`` counts repeated ones."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("h", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(part("role"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") != 0).alias("there"), F.explode(copies).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair.repair(rows, there=F.col("there"), copy=F.col("copy"))


def misspelt_words(docs: DataFrame, least: int = 7) -> DataFrame:
    """word, n of the contract's words: runs of letters, of which one in 31 loses a code point; a null id
    counts as empty text."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.length("word") >= least))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(misspelt_words(read(spark, sf_dir, "documents").select("doc_id", "text")))


OP11_SQL = r"""
with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
firsts as (select h, min(doc_id) as lo from windows group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows join firsts using (h) where doc_id > lo),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from each anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from words left join kept using (doc_id)
"""

# CRC-32 of a list of bytes ``b``, with its table ``t``
CRC_TABLE = "crc as (select list(c order by i) as t from (select i, list_reduce(list_prepend(cast(i as bigint), list_transform(range(8), lambda x: cast(x as bigint))), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)))"
CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

OP12_SQL = rf"""
with recursive {CRC_TABLE},
hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC} % 20 as h
  from (select *, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(unicode(x) as bigint)) as b from conversations), crc),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when h = 3 then [0, 1] else [0] end) as copy
  from hashed where h <> 0),
ids as (select conv_id, row_number() over (order by conv_id) as c from (select distinct conv_id from conversations)),
numbered as (
  select c, turn, role, text, row_number() over (partition by c order by turn nulls first, role, text, copy) as i, row_number() over (partition by c, role, text order by turn nulls first, copy) > 1 as again
  from damaged join ids on damaged.conv_id is not distinct from ids.conv_id),
judged as (
  select *, substr(role, 1, 1) as ini, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when again then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end as fault,
    lead(substr(role, 1, 1)) over (partition by c order by i) as follows from numbered),
counts as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
    count(*) filter (where follows is not null and ini || follows not in ('su', 'ua', 'au')) as illegal, count(*) as n from judged group by c),
-- from the last row back: the cheapest way on from the start, behind s, behind u, behind a
f as (
  select c, n + 1 as i, {{'c': cast(0 as bigint), 'a': ''}} as f0, {{'c': cast(6 as bigint), 'a': 'II'}} as fs, {{'c': cast(3 as bigint), 'a': 'I'}} as fu, {{'c': cast(0 as bigint), 'a': ''}} as fa from counts
  union all
  select c, i, list_min([g0, {{'c': gu.c + 3, 'a': 'I' || gu.a}}, {{'c': ga.c + 6, 'a': 'II' || ga.a}}]), list_min([gs, {{'c': gu.c + 3, 'a': 'I' || gu.a}}, {{'c': ga.c + 6, 'a': 'II' || ga.a}}]),
    list_min([gu, {{'c': ga.c + 3, 'a': 'I' || ga.a}}]), list_min([ga, {{'c': gu.c + 3, 'a': 'I' || gu.a}}])
  from (
    select f.c, judged.i,
      list_min([{{'c': f0.c + 4, 'a': 'D' || f0.a}}, {{'c': case when fault in (1, 2) or ini not in ('s', 'u') then 1000000000 else x end + case when ini = 's' then fs.c else fu.c end, 'a': 'K' || case when ini = 's' then fs.a else fu.a end}}, {{'c': r + fu.c, 'a': 'R' || fu.a}}]) as g0,
      list_min([{{'c': fs.c + 4, 'a': 'D' || fs.a}}, {{'c': case when fault in (1, 2) or ini <> 'u' then 1000000000 else x end + fu.c, 'a': 'K' || fu.a}}, {{'c': r + fu.c, 'a': 'R' || fu.a}}]) as gs,
      list_min([{{'c': fu.c + 4, 'a': 'D' || fu.a}}, {{'c': case when fault in (1, 2) or ini <> 'a' then 1000000000 else x end + fa.c, 'a': 'K' || fa.a}}, {{'c': r + fa.c, 'a': 'R' || fa.a}}]) as gu,
      list_min([{{'c': fa.c + 4, 'a': 'D' || fa.a}}, {{'c': case when fault in (1, 2) or ini <> 'u' then 1000000000 else x end + fu.c, 'a': 'K' || fu.a}}, {{'c': r + fu.c, 'a': 'R' || fu.a}}]) as ga
    from f join (select *, cast(case when fault = 3 then 3 else 0 end as bigint) as x, cast(case when fault in (1, 2) then 1000000000 when fault = 3 then 6 else 3 end as bigint) as r from judged) judged on judged.c = f.c and judged.i = f.i - 1)),
found as (select c, f0.c as cost, f0.a as audit from f where i = 1),
edits as (
  select c, p, audit[p] as edit, len(replace(audit[:p], 'I', '')) as i, len(replace(audit[:p], 'D', '')) as place
  from (select c, audit, unnest(range(1, len(audit) + 1)) as p from found)),
begun as (select edits.c from edits join judged using (c, i) where edit = 'K' and place = 1 and ini = 's'),
said as (
  select e.c, string_agg(case when edit = 'K' then role when (place + case when begun.c is null then 0 else 1 end) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by p) as lines
  from edits e left join judged j on j.c = e.c and j.i = e.i left join begun on begun.c = e.c where edit <> 'D' group by e.c)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
  cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
from ids left join counts using (c) left join found using (c) left join said using (c)
"""

OP13_SQL = rf"""
with recursive {CRC_TABLE},
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
hashed as (
  select run, {CRC} as h from (
    select run, list_concat(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':', ''), lambda x: cast(unicode(x) as bigint)),
      flatten(list_transform(string_split(run, ''), lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [cast(192 + (unicode(x) >> 6) as bigint), cast(128 + (unicode(x) & 63) as bigint)] end))) as b
    from runs where length(run) >= 7), crc),
words as (
  select word, count(*) as n from (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from hashed)
  group by word having length(word) >= 7 and count(*) >= 2),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word as a, a.n as na, b.word as b, b.n as nb from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from less a join words b on a.rest = b.word),
best as (select a as word, count(*) as n_near, max(nb) as top, arg_min(b, {{'m': -nb, 'w': b}}) as form from near group by a),
forms as (select best.word, form, top from best join words using (word) where top >= 10 * n),
chains as (select word, form as root, 1 as k from forms union all select chains.word, form, k + 1 from chains join forms on forms.word = chains.root),
roots as (select word, arg_max(root, k) as root from chains group by word)
select word, form, coalesce(root, word) as root, cast(n as bigint) as n, cast(coalesce(n_near, 0) as bigint) as n_near, cast(top as bigint) as form_n
from words left join (select word, n_near from best) using (word) left join forms using (word) left join roots using (word)
"""

QUERIES = {"op11_debruijn": op11_debruijn, "op12_conversation_repair": op12_conversation_repair, "op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op11_debruijn": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
