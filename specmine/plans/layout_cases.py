"""Queries over positioned words and read logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.operators import layout, pages
from specmine.plans.case import Tables, case
from specmine.sources import records


def clusters(down: str, tolerance: str) -> str:
    return f"""recursive ci as (select doc_id, page, list(struct_pack(k := {down}, x := x, n := item_no, tol := {tolerance}) order by {down}, x, item_no) as l from items where trim(text) <> '' group by 1, 2),
    fold as (select doc_id, page, l, 0 as i, cast([] as double[]) as rs, cast([] as int[]) as ids from ci union all
      select doc_id, page, l, i + 1, case when p is null then list_append(rs, l[i + 1].k) else rs end, list_append(ids, cast(coalesce(p, len(rs) + 1) as int))
      from (select *, list_position(list_transform(rs, lambda r: abs(r - l[i + 1].k) <= l[i + 1].tol), true) as p from fold where i < len(l))),
    cr as (select items.*, f.row_id from (select doc_id, page, unnest(list_transform(l, lambda v: v.n)) as item_no, unnest(ids) as row_id from fold where i = len(l)) f join items using (doc_id, page, item_no))"""


ROWS = clusters("-y", "least(5.0, greatest(2.0, height * 0.38))")
OCR_ROWS = clusters("y + height / 2", "least(12.0, greatest(4.0, height * 0.55))")
JOIN = """jp as (select *, x - max(x + width) over (partition by doc_id, page, row_id order by x, item_no rows between unbounded preceding and 1 preceding) as gap, lag(text) over (partition by doc_id, page, row_id order by x, item_no) as prev from cr)
    select doc_id, page, row_id, string_agg({sep} || trim(text), '' order by x, item_no) as text from jp group by 1, 2, 3"""
SEP = "case when gap is null then '' when gap > 18 then '   ' when gap < height * 0.15 and regexp_matches(text, '^[A-Za-z]') and regexp_matches(prev, '[A-Za-z]$') then '' else ' ' end"


def rows_of(t: Tables) -> DataFrame:
    return layout.cluster_rows(t("items"))


case("l1_cluster_rows", lambda t: rows_of(t).select("doc_id", "page", "item_no", "row_id"), "items", f"{ROWS} select doc_id, page, item_no, row_id from cr")
case("l2_cluster_ocr_rows", lambda t: layout.cluster_ocr_rows(t("items")).select("doc_id", "page", "item_no", "row_id"), "items", f"{OCR_ROWS} select doc_id, page, item_no, row_id from cr")
case("l3_join_row_text", lambda t: layout.join_row_text(rows_of(t)), "items", f"{ROWS}, {JOIN.format(sep=SEP)}")
case("l4_join_ocr_row_text", lambda t: layout.join_ocr_row_text(layout.cluster_ocr_rows(t("items"))), "items", f"{OCR_ROWS}, " + JOIN.format(sep="case when gap is null then '' when gap > greatest(24.0, height * 2) then '   ' else ' ' end"))

# header rows: every document's row 1 names sizes, later rows hold numbers under them
GRID = """grid as (select doc_id, 1 as page, r as row_id, k as item_no, case when r = 1 then case when doc_id % 4 = 0 and k = 2 then 'oneCh' else cast(k * 3 + doc_id % 2 as varchar) || 'Ch' end when (pk + k) % 3 = 0 then 'Dimmer' else cast(ln + k as varchar) end as text,
    cast(k * 50 + case when r > 1 then (pk * k) % 23 else 0 end as double) as x, 12.0 as width, 10.0 as height from base cross join (select unnest([1, 2, 3]) as k) z)"""
HEADERS = GRID + r""", hx as (select *, try_cast(regexp_extract(text, '(?i)^([0-9]{1,3}) ?ch(?:annels?)?$', 1) as int) as n from grid),
    hg as (select doc_id, page, row_id, list(n order by x, item_no) filter (where n is not null) as counts, list(x + width / 2 order by x, item_no) filter (where n is not null) as centres, count(n) as c, count(distinct n) as d, bool_or(regexp_matches(text, '(?i)^[^0-9]+ch$') and n is null) as void from hx group by 1, 2, 3), headers as (select doc_id, page, row_id, counts, centres from hg where c >= 2 and c = d and not void)"""
PITCH = HEADERS + ", pitched as (select *, list_min(list_transform(range(1, len(centres)), lambda i: centres[i + 1] - centres[i])) as pitch from headers)"
ACTIVE = HEADERS + ", active as (select g.doc_id, g.page, g.row_id, last_value(h.row_id ignore nulls) over (partition by g.doc_id, g.page order by g.row_id) as header_row from (select distinct doc_id, page, row_id from grid) g left join headers h using (doc_id, page, row_id))"


def grid(t: Tables) -> DataFrame:
    b = t.kept("base").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    head = F.when((F.col("doc_id") % 4 == 0) & (F.col("k") == 2), "oneCh").otherwise(F.concat((F.col("k") * 3 + F.col("doc_id") % 2).cast("string"), F.lit("Ch")))
    body = F.when((F.col("pk") + F.col("k")) % 3 == 0, "Dimmer").otherwise((F.col("ln") + F.col("k")).cast("string"))
    return b.select("doc_id", F.lit(1).alias("page"), F.col("r").alias("row_id"), F.col("k").alias("item_no"), F.when(F.col("r") == 1, head).otherwise(body).alias("text"), (F.col("k") * 50 + F.when(F.col("r") > 1, (F.col("pk") * F.col("k")) % 23).otherwise(0)).cast("double").alias("x"), F.lit(12.0).alias("width"), F.lit(10.0).alias("height"))


def headers(t: Tables) -> DataFrame:
    return layout.detect_count_headers(grid(t))


def active(t: Tables) -> DataFrame:
    return layout.active_header(grid(t), headers(t))


def told(df: DataFrame) -> DataFrame:
    return df.withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), ",")).withColumn("centres", F.array_join(F.transform("centres", lambda c: c.cast("int").cast("string")), ","))


TOLD = "array_to_string(list_transform(counts, lambda v: cast(v as varchar)), ',') as counts, array_to_string(list_transform(centres, lambda v: cast(cast(v as int) as varchar)), ',') as centres"
case("l5_detect_count_headers", lambda t: told(headers(t)), "base", f"{HEADERS} select doc_id, page, row_id, {TOLD} from headers")


def stacked(t: Tables) -> DataFrame:
    g = grid(t).where("row_id <= 3")
    text = F.when(F.col("row_id") == 1, (F.col("item_no") * 4).cast("string")).when(F.col("row_id") == F.col("doc_id") % 2 + 2, F.when(F.col("doc_id") % 5 == 0, "fn").otherwise("Ch")).otherwise("-")
    return g.withColumn("text", text).withColumn("x", F.col("item_no") * 50.0)


case("l6_detect_stacked_headers", lambda t: layout.detect_stacked_headers(stacked(t)).withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), ",")), "base", "select distinct doc_id, 1 as page, 1 as row_id, '4,8,12' as counts from base where r = doc_id % 2 + 2 and doc_id % 5 > 0")
case("l7_column_pitch", lambda t: layout.column_pitch(headers(t)).select("doc_id", "row_id", "pitch", "left_edge", "right_edge"), "base", f"{PITCH} select doc_id, row_id, pitch, centres[1] - pitch / 2 as left_edge, centres[len(centres)] + pitch / 2 as right_edge from pitched")
case("l8_active_header", active, "base", f"{ACTIVE} select * from active")
case("l9_snap_cells", lambda t: layout.snap_cells(grid(t)).withColumn("cells", F.array_join("cells", "|")), "base", f"""{ACTIVE.replace('headers as', 'headers0 as').replace('left join headers h', 'left join headers0 h')}, pitched as (select *, list_min(list_transform(range(1, len(centres)), lambda i: centres[i + 1] - centres[i])) as pitch from headers0),
    nums as (select g.doc_id, g.page, g.row_id, a.header_row, g.item_no, g.text, g.x + g.width / 2 as c, centres, pitch from grid g join active a using (doc_id, page, row_id) join pitched p on p.doc_id = g.doc_id and p.page = g.page and p.row_id = a.header_row where g.row_id > a.header_row and regexp_matches(g.text, '^[0-9]{{1,3}}$') and g.x + g.width / 2 between centres[1] - pitch / 2 and centres[len(centres)] + pitch / 2),
    near as (select *, unnest(range(0, len(centres))) as col, unnest(list_transform(centres, lambda v: abs(c - v))) as far from nums), best as (select *, far <= pitch * 0.4 as fits from (select *, row_number() over (partition by doc_id, page, row_id, item_no order by far, col) as k from near) where k = 1),
    ok as (select doc_id, page, row_id, header_row, any_value(len(centres)) as width, list(struct_pack(col := col, text := text)) as m from best group by 1, 2, 3, 4 having bool_and(fits) and count(*) = count(distinct col) and count(*) < any_value(len(centres)))
    select doc_id, page, row_id, header_row, array_to_string(list_transform(range(0, width), lambda i: coalesce(list_filter(m, lambda s: s.col = i)[1].text, '-')), '|') as cells from ok""")  # fmt: skip
case("l10_value_column_edge", lambda t: layout.value_column_edge(grid(t), active(t)), "base", f"""{ACTIVE}, e as (select doc_id, page, row_id, max(case when regexp_matches(text, '^[0-9]{{1,3}} ?[-–—] ?[0-9]{{1,3}}$|^[0-9]{{1,3}}$') then x + width end) as e from grid group by 1, 2, 3)
    select doc_id, page, row_id, header_row, max(e) over (partition by doc_id, page, header_row order by row_id) as value_edge from e join active using (doc_id, page, row_id) where header_row is not null""")  # fmt: skip

# ---- OCR sources


def tsv(t: Tables) -> DataFrame:
    c = lambda x: F.col(x).cast("string")
    return t("items").select("doc_id", F.concat_ws("\t", F.when(F.col("item_no") % 4 == 0, "4").otherwise("5"), F.lit("1"), F.lit("1"), F.lit("1"), F.lit("1"), c("item_no"), F.col("x").cast("int").cast("string"), F.col("y").cast("int").cast("string"), F.col("width").cast("int").cast("string"), F.col("height").cast("int").cast("string"), c("confidence"), F.concat("text", F.lit("\ttail"))).alias("value"))


case("s5_parse_ocr_tsv", lambda t: records.parse_ocr_tsv(tsv(t)), "items", "select doc_id, 1 as page, item_no as word_no, trim(text || chr(9) || 'tail') as text, x, y, width, height, cast(confidence as double) as confidence from items where item_no % 4 > 0")


def blocks(t: Tables) -> DataFrame:
    w = F.transform(F.array_sort(F.collect_list(F.struct("item_no", "text", F.col("confidence").cast("double").alias("confidence")))), lambda s: F.struct(s["text"].alias("text"), s["confidence"].alias("confidence")))
    g = t("items").groupBy("doc_id").agg(w.alias("w"))
    line = F.array(F.struct(F.col("w").alias("words")))
    nested = F.array(F.struct(F.array(F.struct(line.alias("lines"))).alias("paragraphs")))
    return g.select("doc_id", nested.alias("blocks"), F.when(F.col("doc_id") % 2 == 0, F.slice("w", 1, 2)).alias("words"))


case("s6_flatten_ocr_blocks", lambda t: records.flatten_ocr_blocks(blocks(t)), "items", "select doc_id, item_no - 1 as word_no, text, cast(confidence as double) as confidence from items where doc_id % 2 = 1 or item_no <= 2")

# ---- readings and logs

case("p6_rank_readings", lambda t: pages.rank_readings(t("items")), "items", """s as (select doc_id, page, rotation, count(*) as n, avg(confidence) as mc, avg(confidence) * sqrt(count(*)) as score from items group by 1, 2, 3), k as (select *, row_number() over w as rk, lead(score) over w as second from s window w as (partition by doc_id, page order by score desc, rotation))
    select doc_id, page, rotation, score, rotation = 0 and n >= 20 and mc >= 58 as upright, coalesce(second > score * 0.75, false) as close_call from k where rk = 1""")  # fmt: skip
case("p7_combine_readings", lambda t: pages.combine_readings(t("items")), "items", "r as (select doc_id, page, rotation, string_agg(text, ' ' order by item_no) as text, sum(confidence) as c from items group by 1, 2, 3) select doc_id, page, string_agg(text, chr(10) order by c desc, rotation) as text from r group by 1, 2")
LOG = "failed as (select doc_id, k as page from log where k is not null group by 1, 2 having not arg_max(ok, struct_pack(a := ts, b := event_id)))"


def failed(t: Tables) -> DataFrame:
    return pages.failed_pages(t("log").select("doc_id", F.col("k").alias("page"), F.col("ts").alias("attempt"), "event_id", "ok"))


case("p8_failed_pages", failed, "log", f"{LOG} select * from failed")
case("p9_page_runs", lambda t: pages.page_runs(failed(t)), "log", f"""{LOG}, g as (select *, page - row_number() over (partition by doc_id order by page) as g from failed), r as (select doc_id, min(page) as a, max(page) as b from g group by doc_id, g), l as (select doc_id, list(case when a = b then cast(a as varchar) else a || '-' || b end order by a) as l from r group by 1)
    select doc_id, case when len(l) = 1 then l[1] else array_to_string(l[:len(l) - 1], ', ') || ' and ' || l[len(l)] end as pages from l""")  # fmt: skip
