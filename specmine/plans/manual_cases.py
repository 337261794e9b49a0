"""Queries over manuals: text, pages, rows and modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from specmine.functions import text as tx
from specmine.operators import modes, pages, rows
from specmine.plans.case import Tables, case
from specmine.plans.document_cases import components_sql
from specmine.sources import manuals
from specmine.sources.files import through_files

# ---- sources

PAGES = "pages_b as (select doc_id, page, string_agg(text, chr(10) order by line_no) as text from lines group by 1, 2)"
DOCS = PAGES + ", docs_b as (select doc_id, string_agg('=== PAGE ' || page || ' ===' || chr(10) || text, chr(10) order by page) as text from pages_b group by 1)"


def page_table(t: Tables):
    return manuals.pages_of_lines(t("lines"))


case("s4_assemble_text", lambda t: manuals.assemble_text(page_table(t)), "lines", f"{DOCS} select * from docs_b")
case("s2_split_pages", lambda t: manuals.split_pages(manuals.assemble_text(page_table(t))), "lines", f"{PAGES} select doc_id, page, text from pages_b")
case("s3_split_lines", lambda t: manuals.split_lines(page_table(t)), "lines", "select doc_id, page, line_no, text from lines")


def _file_lines(t: Tables):
    """All manuals, many to a file of the shared folder; the lines that the file source gives."""
    path = t.folder("manuals")
    manuals.assemble_text(page_table(t)).select(F.expr("pmod(xxhash64(doc_id, 'lines'), 16)").alias("name"), "text").write.partitionBy("name").text(path)
    whole = manuals.read_manual_text(t.spark, f"{path}/*")
    return whole.select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")


def _every_file(t: Tables):
    """All manuals, a file each."""
    named = manuals.assemble_text(page_table(t)).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    return through_files(named, t.folder("manuals"), lambda path: manuals.read_manual_text(t.spark, path).select("text"))


case("s1_read_manual_text", _file_lines, "lines", f"{DOCS} select * from (select unnest(string_split(text, chr(10))) as text from docs_b) where text <> ''")
case("s1_read_every_manual_text", _every_file, "lines", f"{DOCS} select text || chr(10) as text from docs_b")
case(
    "p11_append_region_text",
    lambda t: manuals.append_region_text(manuals.assemble_text(page_table(t)), t("lines").where("line_no = 1").select("doc_id", F.col("text").alias("region_text")).where("doc_id % 3 = 0")),
    "lines",
    f"{DOCS} select d.doc_id, d.text || coalesce(chr(10) || 'Region table' || chr(10) || l.text, '') as text from docs_b d left join lines l on l.doc_id = d.doc_id and l.line_no = 1 and d.doc_id % 3 = 0",
)

# ---- pages

COUNT = "len(regexp_extract_all(text, '{}'))"
RANGES, VALUE_ROW = COUNT.format("[0-9]{1,3} ?[-–—] ?[0-9]{1,3}"), COUNT.format("(?m)^ *[0-9]{1,3} +.*[0-9]{1,3} ?[-–—] ?[0-9]{1,3}")
HEADS = COUNT.format(r"(?i)\b(channel table|channel mode|dmx (chart|channels|values|mode)|function)\b")
STATS = f"stats as (select doc_id, page, {RANGES} as n_ranges, regexp_matches(text, '(?i)\\b(dmx|channel|function|value)') as has_vocabulary, {HEADS} as n_headings from pages_b)"
SCORE = f"case when regexp_matches(text, '(?i)\\b(channel table|channel mode|dmx (chart|channels|values|mode)|function)\\b') then 500.0 else 0.0 end + 25 * {VALUE_ROW} + 8 * {RANGES} + least(length(text), 12000) / 100"

case("p1_pages_needing_ocr", lambda t: pages.pages_needing_ocr(page_table(t)), "lines", f"{PAGES} select * from pages_b where length(text) < 80")
case("p2_page_table_stats", lambda t: pages.page_table_stats(page_table(t)), "lines", f"{PAGES}, {STATS} select * from stats")
case(
    "p3_pages_for_detailed_read",
    lambda t: pages.pages_for_detailed_read(page_table(t).withColumn("from_ocr", F.col("doc_id") % 3 == 0)),
    "lines",
    f"""{PAGES}, {STATS}, u as (select *, doc_id % 3 = 0 or n_ranges < 5 as unreadable from stats),
    heads as (select doc_id, page from u where n_headings between 1 and 3 and unreadable)
    select doc_id, page from heads union select u.doc_id, u.page from u join heads h on h.doc_id = u.doc_id and h.page + 1 = u.page where unreadable
    union select doc_id, page from u where doc_id % 3 = 0 and n_ranges >= 5""",
)
case("p4_table_text_score", lambda t: pages.table_text_score(page_table(t)).select("doc_id", "page", "score"), "lines", f"{PAGES} select doc_id, page, cast({SCORE} as double) as score from pages_b")
case(
    "p5_merge_readings",
    lambda t: pages.merge_readings(page_table(t), page_table(t).where("page % 2 = 1").withColumn("text", F.expr("concat('DMX values ', upper(text))"))),
    "lines",
    f"""{PAGES}, b as (select doc_id, page, text, {SCORE} as s from pages_b), d as (select doc_id, page, text, {SCORE} as s from (select doc_id, page, 'DMX values ' || upper(text) as text from pages_b where page % 2 = 1))
    select b.doc_id, b.page, case when d.s >= b.s * 0.7 then d.text || chr(10) || b.text else b.text end as text from b left join d using (doc_id, page)""",
)
case(
    "p10_dedupe_page_readings",
    lambda t: pages.dedupe_page_readings(t("lines").withColumn("copy", F.col("line_no") % 2)),
    "lines",
    """select doc_id, page, copy, n from (select *, row_number() over (partition by doc_id, page order by n desc, copy desc) as r from (
      select doc_id, page, line_no % 2 as copy, count(*) filter (where regexp_matches(text, '[0-9]{1,3} ?[-–—] ?[0-9]{1,3}')) as n from lines group by 1, 2, 3)) where r = 1""",
)

# ---- rows

NORMAL = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '[|\[\]{}]', ' ', 'g'), '([0-9])[._~]([0-9])', '\1-\2', 'g'), '\s+', ' ', 'g')), '\b(0{1,3})(2[0-9]{2})\b', '\1-\2', 'g')"
RANGE = r"([0-9]{1,3})\s*(?:-|–|—|~|to|\.\.)\s*([0-9]{1,3})"
CLASSIFIED = rf"""classified as (select *,
  try_cast(case when kind = 'full_row' then regexp_extract(line, '{rows.FULL_ROW}', 1) when kind = 'name_only' then regexp_extract(line, '{rows.NAME_ONLY}', 1) end as int) as channel,
  try_cast(case when kind = 'full_row' then regexp_extract(line, '{rows.FULL_ROW}', 2) when kind = 'range_only' then regexp_extract(line, '{rows.RANGE_ONLY}', 1) end as int) as range_start,
  try_cast(case when kind = 'full_row' then regexp_extract(line, '{rows.FULL_ROW}', 3) when kind = 'range_only' then regexp_extract(line, '{rows.RANGE_ONLY}', 2) end as int) as range_end,
  case when kind = 'full_row' then regexp_extract(line, '{rows.FULL_ROW}', 4) when kind = 'range_only' then regexp_extract(line, '{rows.RANGE_ONLY}', 3) when kind = 'name_only' then regexp_extract(line, '{rows.NAME_ONLY}', 2) end as label,
  cast(sum(case when kind = 'heading' then 1 else 0 end) over (partition by doc_id order by line_no) as int) as section
  from (select *, case when regexp_matches(line, '{rows.HEADING}') then 'heading' when regexp_matches(line, '(?i)^(page|rev|user manual|contents?)\b') then 'furniture'
    when regexp_matches(line, '{rows.FULL_ROW}') then 'full_row' when regexp_matches(line, '{rows.RANGE_ONLY}') then 'range_only' when regexp_matches(line, '^(\.{{2,}}|…)$') then 'ellipsis'
    when regexp_matches(line, '{rows.NAME_ONLY}') then 'name_only' else 'other' end as kind from (select *, {NORMAL} as line from lines)))"""
CARRIED = CLASSIFIED + ", carried as (select * from (select *, last_value(channel ignore nulls) over (partition by doc_id, section order by line_no) as position from classified) where kind in ('full_row', 'range_only') and position is not null)"


def classified(t: Tables):
    return rows.classify_lines(t("lines"))


case("r1_normalize_line", lambda t: t("lines").select("doc_id", "line_no", tx.normalize_line(F.concat("text", F.lit(" | 0255 [1.5]"))).alias("line")), "lines", f"select doc_id, line_no, {NORMAL} as line from (select doc_id, line_no, text || ' | 0255 [1.5]' as text from lines)")
case(
    "r2_clean_function",
    lambda t: t("lines").select("doc_id", "line_no", tx.clean_function(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("|eset "), "text", F.lit("..."))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Vode_table (2) "), "text")).otherwise(F.col("text"))).alias("name")),
    "lines",
    r"""x as (select doc_id, line_no, trim(regexp_replace(regexp_replace(case doc_id % 3 when 0 then '|eset ' || text || '...' when 1 then 'Vode_table (2) ' || text else text end, '^[|:;.,\-_~"`''\s]+|[|:;.,\s]+$', '', 'g'), '\s+', ' ', 'g')) as c from lines),
    y as (select doc_id, line_no, regexp_replace(regexp_replace(c, '(?i)^eset\b', 'Reset'), '(?i)^hutter\b', 'Shutter') as c from x)
    select doc_id, line_no, case when regexp_matches(c, '(?i)^[mv]ode[_\s-]*table[_\s-]*\(?([12id])\)?') then 'Mode table ' || case when regexp_extract(c, '(?i)^[mv]ode[_\s-]*table[_\s-]*\(?([12id])\)?', 1) = '2' then '2' else '1' end || regexp_replace(c, '(?i)^[mv]ode[_\s-]*table[_\s-]*\(?([12id])\)?', '') else c end as name from y""",
)
case("r3_page_furniture", lambda t: t("lines").where(tx.is_page_furniture(F.col("text"))).select("doc_id", "line_no"), "lines", r"select doc_id, line_no from lines where text like '=%' or regexp_matches(text, '(?i)^(page|p\.?\s*[0-9]|rev(ision)?|user manual|contents?)\b') or regexp_matches(text, '(?i)\buser manual\b')")
case("r4_classify_lines", lambda t: classified(t).select("doc_id", "line_no", "kind", "channel", "range_start", "range_end", "label"), "lines", f"{CLASSIFIED} select doc_id, line_no, kind, channel, range_start, range_end, label from classified")
case(
    "r5_rejoin_split_digits",
    lambda t: rows.rejoin_split_digits(t("lines").withColumn("text", F.regexp_replace("text", "([0-9])([0-9]{2})-([0-9])", "$1 $2-$3"))).select("doc_id", "line_no", "fixed", "rejoined"),
    "lines",
    rf"""x as (select doc_id, line_no, regexp_replace(text, '([0-9])([0-9]{{2}})-([0-9])', '\1 \2-\3', 'g') as text from lines),
    y as (select *, regexp_replace(text, '\b([0-9]) ([0-9]{{1,2}})\b', '\1\2', 'g') as again from x),
    z as (select *, try_cast(regexp_extract(text, '{RANGE}', 1) as int) as a, try_cast(regexp_extract(text, '{RANGE}', 2) as int) as b, try_cast(regexp_extract(again, '{RANGE}', 1) as int) as c, try_cast(regexp_extract(again, '{RANGE}', 2) as int) as d from y)
    select doc_id, line_no, case when r then again else text end as fixed, r as rejoined from (select *, not coalesce(a <= b and b <= 255, false) and coalesce(c <= d and d <= 255, false) as r from z)""",
)
case("r6_carry_channel", lambda t: rows.carry_channel(classified(t)).select("doc_id", "section", "line_no", "position", "range_start", "range_end"), "lines", f"{CARRIED} select doc_id, section, line_no, position, range_start, range_end from carried")
case(
    "r7_accept_in_sequence",
    lambda t: rows.accept_in_sequence(rows.sections(classified(t)).where("channel is not null"), ["doc_id", "section"]),
    "lines",
    f"""recursive {CLASSIFIED}, n as (select doc_id, section, line_no, channel, row_number() over (partition by doc_id, section order by line_no) as i from classified where channel is not null),
    walk as (select doc_id, section, i, line_no, channel + 1 as want, true as kept from n where i = 1
      union all select n.doc_id, n.section, n.i, n.line_no, case when n.channel = w.want then w.want + 1 else w.want end, n.channel = w.want from walk w join n on n.doc_id = w.doc_id and n.section = w.section and n.i = w.i + 1)
    select doc_id, section, line_no from walk where kept""",
)
CELLS = rf"""cells as (select doc_id, page, line_no, regexp_split_to_array(trim(regexp_extract(text, '^((?:(?:[0-9]{{1,3}}|-)\s+){{2}})({RANGE}\s+.*)$', 1)), '\s+') as cells,
  regexp_extract(text, '^((?:(?:[0-9]{{1,3}}|-)\s+){{2}})({RANGE}\s+.*)$', 2) as rest from lines where regexp_matches(text, '^((?:(?:[0-9]{{1,3}}|-)\s+){{2}})({RANGE}\s+.*)$'))"""
MATRIX = CELLS + ", matrix as (select doc_id, mode_col, position, line_no, rest from (select *, row_number() over (partition by doc_id, mode_col, position order by line_no) as r from (select doc_id, line_no, rest, k as mode_col, try_cast(cells[k + 1] as int) as position from cells, (select unnest(range(0, 2)) as k) where cells[k + 1] <> '-')) where r = 1)"
case("r8_explode_matrix_rows", lambda t: rows.explode_matrix_rows(rows.row_cells(t("lines"))), "lines", f"{MATRIX} select * from matrix")
case("r9_plausible_rows", lambda t: rows.plausible_rows(rows.row_cells(t("lines")), F.array(F.lit(4), F.lit(None).cast("int"))).select("doc_id", "line_no", "plausible"), "lines", f"{CELLS} select doc_id, line_no, cells[1] = '-' or (try_cast(cells[1] as int) between 1 and 4) as plausible from cells")
case(
    "r10_merge_split_rows",
    lambda t: rows.merge_split_rows(t("lines").withColumn("text", F.when(F.col("line_no") % 5 == 0, "3   -").otherwise(F.col("text")))),
    "lines",
    r"""x as (select doc_id, line_no, case when line_no % 5 = 0 then '3   -' else text end as text from lines), u as (select *, regexp_matches(text, '^([0-9]{1,3}|-)(\s+([0-9]{1,3}|-))*$') as bare from x where not regexp_matches(text, '(?i)^(page|user manual|\.{2,})')),
    v as (select *, lead(text) over w as nxt, coalesce(lag(bare) over w, false) as eaten from u window w as (partition by doc_id order by line_no))
    select doc_id, line_no, case when bare and nxt is not null then text || '   ' || nxt else text end as text from v where not eaten or bare""",
)
case("r11_infer_mode_size", lambda t: rows.infer_mode_size(rows.explode_matrix_rows(rows.row_cells(t("lines")))), "lines", f"{MATRIX} select doc_id, mode_col, max(position) as mode_size from matrix group by 1, 2")
case(
    "r12_assign_ranges",
    lambda t: rows.assign_ranges(rows.carry_channel(classified(t))),
    "lines",
    f"""recursive {CARRIED}, n as (select *, row_number() over (partition by doc_id, section order by line_no) as i from carried),
    walk as (select doc_id, section, i, line_no, channel as opened, range_start, range_end, case when channel is null then -1 else range_end end as reach, channel is not null as takes from n where i = 1
      union all select n.doc_id, n.section, n.i, n.line_no, coalesce(n.channel, w.opened), n.range_start, n.range_end,
        case when n.channel is not null then n.range_end when w.opened is not null and w.reach < 255 then greatest(w.reach, n.range_end) else w.reach end,
        n.channel is not null or (w.opened is not null and w.reach < 255) from walk w join n on n.doc_id = w.doc_id and n.section = w.section and n.i = w.i + 1)
    select doc_id, section, opened as position, line_no, range_start, range_end from walk where takes""",
)
case(
    "r13_parse_range",
    lambda t: t("lines").select("doc_id", "line_no", tx.parse_range(F.col("text")).alias("r")).select("doc_id", "line_no", "r.start", "r.end", "r.label"),
    "lines",
    rf"""x as (select doc_id, line_no, try_cast(regexp_extract(text, '{RANGE}', 1) as int) as a, try_cast(regexp_extract(text, '{RANGE}', 2) as int) as b, substr(trim(regexp_replace(regexp_replace(text, '^.*?{RANGE}', ''), '^[\s:=-]+', '')), 1, 80) as l from lines)
    select doc_id, line_no, case when a <= b and b <= 255 then a end as start, case when a <= b and b <= 255 then b end as "end", case when a <= b and b <= 255 then case when l = '' then 'Full range' else l end end as label from x""",
)
case(
    "r26_block_rows",
    lambda t: rows.block_rows(classified(t)),
    "lines",
    f"""{CLASSIFIED}, o as (select *, cast(sum(case when kind in ('full_row', 'name_only') then 1 else 0 end) over (partition by doc_id, section order by line_no) as int) as block from classified where kind in ('full_row', 'range_only', 'name_only'))
    select doc_id, section, block, arg_min(label, line_no) as name, max(channel) as position, min(range_start) as low, max(range_end) as high, count(*) as n_lines from o group by 1, 2, 3""",
)
BLOCKS = f"""{CLASSIFIED}, o as (select *, cast(sum(case when kind in ('full_row', 'name_only') then 1 else 0 end) over (partition by doc_id, section order by line_no) as int) as block from classified where kind in ('full_row', 'range_only', 'name_only')),
    blocks as (select doc_id, section, block, arg_min(label, line_no) as name, max(channel) as position, min(range_start) as low, max(range_end) as high, count(*) as n_lines from o group by 1, 2, 3)"""
case(
    "r27_fold_unplaced_blocks",
    lambda t: rows.fold_unplaced_blocks(rows.block_rows(classified(t))),
    "lines",
    f"""{BLOCKS} select doc_id, section, block, name, case when position is not null then position when lag(high) over w + 1 = low then lag(position) over w when high + 1 = lead(low) over w then lead(position) over w end as position from blocks window w as (partition by doc_id, section order by block)""",
)
case("r28_continued_blocks", lambda t: rows.continued_blocks(rows.block_rows(classified(t))), "lines", f"{BLOCKS} select doc_id, position, arg_min(name, struct_pack(s := section, b := block)) as name, min(low) as low, max(high) as high, sum(n_lines) as n_lines from blocks where position is not null group by 1, 2")
case(
    "r29_appendix_ranges",
    lambda t: rows.appendix_ranges(t("lines")),
    "lines",
    rf"""{CLASSIFIED}, a as (select *, sum(length(text) + 1) over w as run, regexp_matches(text, '(?i)dmx channel table') as head from classified window w as (partition by doc_id order by line_no)),
    b as (select *, last_value(case when head then run end ignore nulls) over w as since, last_value(case when kind = 'heading' then head end ignore nulls) over w as inside from a window w as (partition by doc_id order by line_no)),
    c as (select *, try_cast(regexp_extract(line, '{RANGE}', 1) as int) as a, try_cast(regexp_extract(line, '{RANGE}', 2) as int) as b, substr(trim(regexp_replace(regexp_replace(line, '^.*?{RANGE}', ''), '^[\s:=-]+', '')), 1, 80) as l from b where inside and kind in ('range_only', 'full_row') and run - since <= 8000)
    select doc_id, line_no, a as start, b as "end", case when l = '' then 'Full range' else l end as label from c where a <= b and b <= 255""",
)
case(
    "r36_table_channels_fallback",
    lambda t: rows.table_channels_fallback(classified(t), t("lines").select("doc_id", (F.col("doc_id") % 4 * 4).alias("channel_count")).distinct()),
    "lines",
    f"""recursive {CLASSIFIED}, n as (select doc_id, section, line_no, channel, row_number() over (partition by doc_id, section order by line_no) as i from classified where channel is not null and kind in ('full_row', 'name_only')),
    walk as (select doc_id, section, i, line_no, channel + 1 as want, true as kept from n where i = 1
      union all select n.doc_id, n.section, n.i, n.line_no, case when n.channel = w.want then w.want + 1 else w.want end, n.channel = w.want from walk w join n on n.doc_id = w.doc_id and n.section = w.section and n.i = w.i + 1),
    c as (select doc_id, section, count(*) as n_rows from walk where kept group by 1, 2)
    select doc_id, section, n_rows from (select *, row_number() over (partition by doc_id order by n_rows desc, section desc) as r from c) where r = 1 and n_rows >= 4 and n_rows >= ceil(doc_id % 4 * 4 * 0.5)""",
)
case(
    "r37_recover_ordered_rows",
    lambda t: rows.recover_ordered_rows(classified(t)),
    "lines",
    f"""recursive {CLASSIFIED}, n as (select doc_id, section, line_no, channel, row_number() over (partition by doc_id, section order by line_no) as i from classified where kind in ('full_row', 'range_only')),
    walk as (select doc_id, section, i, line_no, coalesce(channel, 1) as position, case when channel is null then 0.6 else 0.7 end as confidence from n where i = 1
      union all select n.doc_id, n.section, n.i, n.line_no, coalesce(n.channel, w.position + 1), case when n.channel is null then 0.6 else 0.7 end from walk w join n on n.doc_id = w.doc_id and n.section = w.section and n.i = w.i + 1)
    select doc_id, section, line_no, position, cast(confidence as double) as confidence from walk""",
)

# ---- modes

W = "window w as (partition by doc_id order by line_no)"
DECLARED = r"""hits as (select doc_id, line_no, unnest(l) as n, unnest(range(len(l))) as k from (select doc_id, line_no, regexp_extract_all(text, '(?i)\b([0-9]{1,3})[ -]?(?:ch|channels?|dmx channels?)\b', 1) as l from lines)),
    declared as (select doc_id, size, row_number() over (partition by doc_id order by line_no, k, size) as seen from (select doc_id, size, line_no, k from (select *, row_number() over (partition by doc_id, size order by line_no, k) as r from (select doc_id, line_no, k, cast(n as int) as size from hits) where size between 1 and 512) where r = 1))"""
SECTIONS = r"""sections as (select * from (select *, cast(sum(case when head or stop then 1 else 0 end) over w as int) as section, last_value(case when head then text when stop then '' end ignore nulls) over w as heading
    from (select *, regexp_matches(text, '(?i)\b(dmx channel table|channel mode|dmx values|dmx channels)\b') or regexp_matches(text, '(?i)ch function$') as head, regexp_matches(text, '(?i)user manual') as stop from lines) window w as (partition by doc_id order by line_no)) where heading <> '')"""
TABLES = SECTIONS + r""", nums as (select distinct doc_id, section, v from (select doc_id, section, try_cast(regexp_extract(text, '^([0-9]{1,3})\s', 1) as int) as v, sum(length(text) + 1) over (partition by doc_id, section order by line_no) as run from sections) where v is not null and run <= 30000),
    table_counts as (select doc_id, max(n) as table_count from (select doc_id, section, max(v) as n from (select *, row_number() over (partition by doc_id, section order by v) as r from nums) where v = r group by 1, 2) group by 1)"""

case("m1_declared_mode_counts", lambda t: modes.declared_mode_counts(t("lines")), "lines", f"{DECLARED} select doc_id, size, seen from declared")
case("m2_table_row_count", lambda t: modes.table_row_count(t("lines")), "lines", f"{TABLES} select * from table_counts")
case(
    "m3_reconcile_counts",
    lambda t: modes.reconcile_counts(modes.declared_mode_counts(t.kept("lines")), modes.table_row_count(t.kept("lines")), t.kept("lines").select("doc_id").distinct().where("doc_id % 10 = 0")),
    "lines",
    f"""{DECLARED}, {TABLES}, n as (select doc_id, count(*) as k, max(size) as top from declared group by 1),
    u as (select t.doc_id, t.table_count as size, coalesce(n.k = 1 and n.top > 2 * t.table_count and t.doc_id % 10 <> 0, false) as replaces from table_counts t left join n using (doc_id) where t.table_count >= 4 and (n.k is null or n.k = 1))
    select doc_id, size from declared where doc_id not in (select doc_id from u where replaces) union select doc_id, size from u""",
)
case("m4_sections_by_heading", lambda t: modes.sections_by_heading(t("lines")).select("doc_id", "line_no", "section", "heading"), "lines", f"{SECTIONS} select doc_id, line_no, section, heading from sections")
LIST = "array_to_string(list_transform({}, lambda x: coalesce(cast(x as varchar), '?')), ',')"


def joined_counts(df):
    return df.withColumn("counts", F.array_join("counts", ",", "?"))


LABELED = r"labeled as (select doc_id, page, line_no, list_transform(regexp_extract_all(text, '(?i)\b([0-9]{1,3}) ?ch\b', 1), lambda x: cast(x as int)) as counts from lines where regexp_matches(text, '(?i)function') and len(regexp_extract_all(text, '(?i)\b([0-9]{1,3}) ?ch\b', 1)) >= 2)"
case("m5_header_labeled", lambda t: joined_counts(modes.header_labeled(t("lines"))), "lines", f"{LABELED} select doc_id, page, line_no, {LIST.format('counts')} as counts from labeled")
ABOVE = "placed as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before from matrix_lines), whole as (select doc_id, string_agg(text, chr(10) order by line_no) || chr(10) as whole from matrix_lines group by 1), near as (select p.*, right(substr(whole, 1, cast(before as bigint)), {}) as above from placed p join whole using (doc_id))"
case(
    "m6_header_sparse",
    lambda t: joined_counts(modes.header_sparse(t("matrix_lines"))),
    "matrix_lines",
    rf"""{ABOVE.format(500)}, h as (select doc_id, page, line_no, above, regexp_extract_all(regexp_extract(text, '(?i)^[ \t]*([0-9]{{1,3}}(?:[ \t]+[0-9]{{1,3}}){{1,7}})[ \t]+function\b', 1), '[0-9]{{1,3}}') as c from near where regexp_matches(text, '(?i)^[ \t]*([0-9]{{1,3}}(?:[ \t]+[0-9]{{1,3}}){{1,7}})[ \t]+function\b')),
    g as (select * from h where len(list_distinct(c)) = len(c))
    select doc_id, page, line_no, array_to_string(c, ',') as counts from g where doc_id in (select doc_id from g where regexp_matches(above, '[0-9]{{1,3}}\s*:\s*[A-Za-z]'))""",
)
case(
    "m7_header_index_total",
    lambda t: joined_counts(modes.header_index_total(t("matrix_lines"))),
    "matrix_lines",
    rf"""{ABOVE.format(400)}, x as (select *, regexp_extract(text, '^[ \t]*((?:[0-9]{{1,2}}/[0-9]{{1,3}}[ \t]+){{1,7}})Value\b', 1) as total, regexp_extract(text, '^[ \t]*((?:[0-9]{{1,2}}[ \t]+){{1,7}})Value\b', 1) as bare from near where regexp_matches(above, '(?i)Mode\s*/\s*(?:Total\s+)?channels?\b'))
    select doc_id, page, line_no, case when total <> '' then array_to_string(regexp_extract_all(total, '/([0-9]{{1,3}})', 1), ',') else array_to_string(list_transform(regexp_extract_all(bare, '[0-9]{{1,2}}'), lambda v: '?'), ',') end as counts from x where total <> '' or bare <> ''""",
)
case(
    "m8_header_traits",
    lambda t: joined_counts(modes.header_traits(t("lines"))),
    "lines",
    r"""x as (select doc_id, page, line_no, regexp_extract_all(text, '(?i)\b([0-9]{1,3} ?ch[a-z]?)\b', 1) as own, regexp_extract_all(text, '(?i)\b([0-9]{1,3}) ?ch[a-z]?\b', 1) as n from lines)
    select doc_id, page, line_no, array_to_string(n, ',') as counts from x where len(own) >= 2 and len(list_distinct(list_transform(own, lambda v: lower(v)))) = len(own) and len(n) between 2 and 16 and list_min(list_transform(n, lambda v: cast(v as int))) >= 1 and list_max(list_transform(n, lambda v: cast(v as int))) <= 512""",
)
case(
    "m9_merge_header_runs",
    lambda t: joined_counts(modes.merge_header_runs(modes.header_labeled(t("lines")))),
    "lines",
    f"""{LABELED}, r as (select *, sum(case when counts = prev then 0 else 1 end) over (partition by doc_id order by line_no) as run from (select *, lag(counts) over (partition by doc_id order by line_no) as prev from labeled))
    select doc_id, cast(run as int) as run, min(line_no) as line_no, any_value({LIST.format('counts')}) as counts from r group by 1, 2""",
)
case(
    "m10_sequential_headings",
    lambda t: modes.sequential_headings(t("lines")),
    "lines",
    r"""h as (select doc_id, line_no, cast(unnest(regexp_extract_all(text, '(?i)\b([0-9]{1,3})[ -]channel mode', 1)) as int) as size from lines)
    select doc_id, size, min(line_no) as line_no from h where doc_id in (select doc_id from lines where regexp_matches(text, '(?i)channel table')) or doc_id in (select doc_id from h group by 1 having count(*) >= 2) group by 1, 2""",
)
CODED = r"coded as (select doc_id, line_no, cast(regexp_extract(text, '(?i)\bt[a4]b[l1i]e\s+([0-9]{1,3})\s*([A-Z0-9]{0,3})\b', 1) as int) as size, upper(regexp_extract(text, '(?i)\bt[a4]b[l1i]e\s+([0-9]{1,3})\s*([A-Z0-9]{0,3})\b', 1) || regexp_extract(text, '(?i)\bt[a4]b[l1i]e\s+([0-9]{1,3})\s*([A-Z0-9]{0,3})\b', 2)) as code from lines where regexp_matches(text, '(?i)\bt[a4]b[l1i]e\s+([0-9]{1,3})\s*([A-Z0-9]{0,3})\b'))"
case("m11_coded_headings", lambda t: modes.coded_headings(t("lines")), "lines", f"{CODED} select * from coded")
case(
    "m12_collapse_code_aliases",
    lambda t: modes.collapse_code_aliases(modes.coded_headings(t("lines")).withColumn("code", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("code", "B$", "")).when(F.col("doc_id") % 3 == 1, F.translate("code", "B", "A")).otherwise(F.regexp_replace("code", "[A-Z]B$", "")))),
    "lines",
    rf"""{CODED}, c as (select distinct doc_id, size, case doc_id % 3 when 0 then regexp_replace(code, 'B$', '') when 1 then replace(code, 'B', 'A') else regexp_replace(code, '[A-Z]B$', '') end as code from coded),
    near as (select a.doc_id, a.size, a.code, b.code as other from c a join c b on a.doc_id = b.doc_id and a.size = b.size and a.code <> b.code where (regexp_matches(a.code, '^[0-9]+$') and not regexp_matches(b.code, '^[0-9]+$')) or (length(a.code) = length(b.code) - 1 and levenshtein(a.code, b.code) = 1 and not regexp_matches(a.code, '^[0-9]+$')) or replace(a.code, 'G', 'C') = b.code),
    one as (select doc_id, size, code, min(other) as canonical from near group by 1, 2, 3 having count(*) = 1)
    select doc_id, size, code, coalesce(canonical, code) as canonical from c left join one using (doc_id, size, code)""",
)
case(
    "m13_named_headings",
    lambda t: modes.named_headings(t("lines")),
    "lines",
    f"""h as (select doc_id, line_no, regexp_extract(text, '^([A-Z][a-z]+)', 1) as name, cast(regexp_extract(nxt, '^([0-9]+)', 1) as int) as size from (select *, lead(text) over w as nxt from lines {W}) where regexp_matches(text, '^[A-Z][a-z]+ DMX Mode$') and regexp_matches(nxt, '^[0-9]{{1,3}} DMX channels$'))
    select doc_id, line_no, name, size from (select *, count(*) over (partition by doc_id) as k from h) where k >= 2""",
)
TRAITS = "case when line_no = 1 and doc_id % 8 = 5 then 'DMX Traits of pan, tilt and 16-bit scan' when line_no = 1 and doc_id % 8 = 3 then 'pan, tilt and prism' else text end"
FLAT_LINES = f"flat_lines as (select doc_id, string_agg({TRAITS}, ' ' order by line_no) as text from lines group by 1)"


def with_traits(t: Tables):
    return t.kept("lines").withColumn("text", F.expr(TRAITS))


def flat_lines(t: Tables):
    """A manual's lines in one text."""
    return with_traits(t).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))


case(
    "m17_channel_counts",
    lambda t: modes.channel_counts(with_traits(t), modes.table_row_count(t.kept("lines")).where("doc_id % 3 > 0"), modes.declared_mode_counts(t.kept("lines")), rows.component_scan(flat_lines(t))),
    "lines",
    rf"""{DECLARED}, {TABLES}, {FLAT_LINES}, {components_sql("flat_lines")}, known as (select doc_id, count(*) as k from found group by 1),
    v as (select doc_id, regexp_matches(regexp_replace(text, '\s+', ' ', 'g'), '(?i)(channel value table|dmx channel assignments(?: and values)?|dmx charts?|dmx traits|dmx channels?\s*[:\-]?\s*[0-9])') as has_vocabulary from flat_lines)
    select doc_id, has_vocabulary, cast(coalesce(table_count, (select max(size) from declared d where d.doc_id = v.doc_id), case when has_vocabulary then k end, 0) as int) as channel_count from v left join (select * from table_counts where doc_id % 3 > 0) using (doc_id) left join known using (doc_id)""",
)
