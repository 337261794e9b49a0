"""Queries over records: channels, ranges, validation, catalogs, evaluation, lookup, publishing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.functions import channels as ch
from specmine.functions import text as tx
from specmine.operators import catalog, evaluate, lookup, modes, publish, rows, validate
from specmine.plans.case import Tables, case
from specmine.sources import records
from specmine.sources.files import through_files, whole_texts

# ---- records: nested and flat


def nested(t: Tables) -> DataFrame:
    return records.nest_fixtures(t("fixtures").select("doc_id"), t("channels"), t("ranges"), t("modes"), t("assignments"))


def flat(t: Tables, name: str) -> DataFrame:
    n = nested(t).withColumnRenamed("doc_id", "id").withColumns({"wheels": F.array().cast("array<struct<id:string,name:string,kind:string,slots:array<struct<number:int,name:string,color:string>>>>")})
    wide = n.withColumn("channels", F.transform("channels", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["kind"].alias("kind"), c["color"].alias("color"), c["fineOf"].alias("fineOf"), F.lit(None).cast("string").alias("wheelId"), F.lit("").alias("gdtfAttribute"), F.lit("").alias("gdtfFeature"), c["confidence"].alias("confidence"), c["ranges"].alias("ranges"))))
    wide = wide.withColumn("modes", F.transform("modes", lambda m: m.withField("shortName", m["name"])))
    return records.normalize_fixtures(wide)[name]


case("s8_normalize_channels", lambda t: flat(t, "channels").select("doc_id", "channel_idx", "channel_id", "name", "kind", "color", "fine_of", "confidence"), "channels", """select doc_id, cast(row_number() over (partition by doc_id order by channel_idx) as int) - 1 as channel_idx, channel_id, name, kind, color, fine_of, confidence from channels""")
case("s8_normalize_assignments", lambda t: flat(t, "assignments"), "assignments", "select doc_id, cast(dense_rank() over (partition by doc_id order by mode_idx) as int) - 1 as mode_idx, slot_idx, channel_id, channel_offset, dmx_break from assignments")
case("s8_normalize_modes", lambda t: flat(t, "modes").select("doc_id", "mode_idx", "mode_id", "name", "breaks"), "modes", "select doc_id, cast(dense_rank() over (partition by doc_id order by mode_idx) as int) - 1 as mode_idx, mode_id, name, breaks from modes")
case("s9_nest_fixtures", lambda t: nested(t).select("doc_id", F.size("channels").alias("n_channels"), F.size("modes").alias("n_modes"), F.array_join(F.transform("channels", lambda c: c["id"]), ",").alias("ids")), "channels modes", """c as (select doc_id, count(*) as n, string_agg(channel_id, ',' order by channel_idx) as ids from channels group by 1), m as (select doc_id, count(*) as n from modes group by 1)
    select o_orderkey as doc_id, c.n as n_channels, m.n as n_modes, c.ids from orders left join c on c.doc_id = o_orderkey left join m on m.doc_id = o_orderkey""")  # fmt: skip


def fixture_files(t: Tables) -> DataFrame:
    """Every record written as a JSON file of its own, one in 50 of them broken, and read back."""
    n = nested(t).withColumns({"id": F.col("doc_id").cast("string"), "channels": F.transform("channels", lambda c: c.dropFields("kind"))})
    text = F.to_json(F.struct("id", "channels", "modes"))
    broken = F.when(F.col("doc_id") % 50 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    named = n.select(F.concat("id", F.lit(".txt")).alias("name"), broken.alias("text"))
    good, bad = records.parse_fixtures(through_files(named, t.folder("fixtures"), lambda path: whole_texts(t.spark, path, "*.txt")))
    kinds = F.array_join(F.array_distinct(F.transform("channels", lambda c: c["kind"])), ",")
    listed = good.select(F.col("id").cast("bigint").alias("doc_id"), F.size("channels").alias("n_channels"), F.size("modes").alias("n_modes"), kinds.alias("kinds"))
    lost = bad.agg(F.count("*").cast("int").alias("n_channels")).select(F.lit(-1).cast("bigint").alias("doc_id"), "n_channels", F.lit(0).alias("n_modes"), F.lit("unread").alias("kinds"))
    return listed.unionByName(lost)


case("s7_read_fixtures", fixture_files, "channels modes", """c as (select doc_id, count(*) as n from channels group by 1), m as (select doc_id, count(*) as n from modes group by 1)
    select o_orderkey as doc_id, coalesce(c.n, 0) as n_channels, coalesce(m.n, 0) as n_modes, case when c.n > 0 then 'generic' else '' end as kinds from orders left join c on c.doc_id = o_orderkey left join m on m.doc_id = o_orderkey where o_orderkey % 50 > 0
    union all select -1, count(*), 0, 'unread' from orders where o_orderkey % 50 = 0""")  # fmt: skip


def taxonomy_file(t: Tables) -> DataFrame:
    """Attribute definitions of all parts written as XML documents of 1000 and read back."""
    k, path = F.col("p_partkey"), t.folder("taxonomy")
    pretty = F.when(k % 3 > 0, F.concat(F.lit(' Pretty="'), F.col("p_name"), F.lit('"'))).otherwise("")
    feature = F.when(k % 4 > 0, F.concat(F.lit(' Feature="'), F.col("p_type"), F.lit('"'))).otherwise("")
    one = F.concat(F.lit('<Attribute Name="A'), k.cast("string"), F.lit('"'), pretty, feature, F.lit("/>"))
    whole = t("part").groupBy(F.floor(k / 1000).alias("n")).agg(F.concat(F.lit("<Attributes>"), F.array_join(F.collect_list(one), ""), F.lit("</Attributes>")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return records.read_taxonomy_xml(t.spark, path)


case("s12_read_taxonomy_xml", taxonomy_file, "", "select 'A' || p_partkey as name, case when p_partkey % 3 > 0 then p_name else 'A' || p_partkey end as pretty, case when p_partkey % 4 > 0 then p_type else 'Control.Control' end as feature from part")
whole = {"ignoreNullFields": "false"}
case("s13_fixture_json", lambda t: nested(t).select("doc_id", F.to_json(F.struct("doc_id", "channels", "modes"), whole).alias("json")), "channels ranges modes assignments", """r as (select doc_id, channel_id, list({'start': range_start, 'end': range_end, 'name': name, 'safety': safety, 'confidence': {'score': confidence}} order by range_idx) as ranges from ranges group by 1, 2),
    c as (select c.doc_id, list({'id': c.channel_id, 'name': name, 'kind': kind, 'color': color, 'fineOf': fine_of, 'confidence': {'score': confidence}, 'ranges': coalesce(ranges, [])} order by channel_idx) as channels from channels c left join r on r.doc_id = c.doc_id and r.channel_id = c.channel_id group by 1),
    a as (select doc_id, mode_idx, list({'channelId': channel_id, 'offset': channel_offset, 'dmxBreak': dmx_break} order by slot_idx) as slots from assignments group by 1, 2),
    m as (select m.doc_id, list({'id': mode_id, 'name': name, 'breaks': breaks, 'channels': coalesce(slots, [])} order by m.mode_idx) as modes from modes m left join a on a.doc_id = m.doc_id and a.mode_idx = m.mode_idx group by 1)
    select o_orderkey as doc_id, cast(to_json({'doc_id': o_orderkey, 'channels': channels, 'modes': modes}) as varchar) as json from orders left join c on c.doc_id = o_orderkey left join m on m.doc_id = o_orderkey""")  # fmt: skip
case("s15_extraction_summary", lambda t: records.extraction_summary(t("fixtures"), t("modes"), t("assignments")), "fixtures modes assignments", """s as (select doc_id, mode_idx, count(distinct (dmx_break, channel_offset)) as n from assignments group by 1, 2),
    l as (select doc_id, string_agg(name || ':' || n, ', ' order by mode_idx) as footprints from modes join s using (doc_id, mode_idx) group by 1)
    select doc_id, manufacturer, model, coalesce(footprints, '') as footprints, footprints is null as failed from fixtures left join l using (doc_id)""")  # fmt: skip
case("s15_extraction_totals", lambda t: records.extraction_totals(records.extraction_summary(t("fixtures"), t("modes"), t("assignments"))), "fixtures modes assignments", "l as (select distinct doc_id from modes join assignments using (doc_id, mode_idx)) select count(l.doc_id) as ok, count(*) - count(l.doc_id) as failed from fixtures left join l using (doc_id)")
case("s10_read_truth", lambda t: records.read_truth(t("truth_fixtures"), t("truth_modes"), t("truth_channels"), t("truth_functions"))[2].select("channel_id", "mode_id", "offset_coarse"), "truth_fixtures truth_modes truth_channels", "select channel_id, mode_id, offset_coarse from truth_channels join truth_modes using (mode_id) join truth_fixtures using (fixture_id) where source = 'library'")
MANIFEST = """manifest_lines as (select o_orderkey as line_no, case when o_orderkey = 0 then 'File | Note | GUID' when o_orderkey % 7 = 0 then '' else 'm' || (o_orderkey // 3) || '.txt | note | ' || case when o_orderkey % 2 = 0 then 'abcd-ef' || lpad(cast(o_orderkey as varchar), 6, '0') else o_orderkey || ' (int id x)' end end as value from orders)"""


def manifest_lines(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    tail = F.when(o % 2 == 0, F.concat(F.lit("abcd-ef"), F.lpad(o.cast("string"), 6, "0"))).otherwise(F.concat(o.cast("string"), F.lit(" (int id x)")))
    return t("orders").select(o.alias("line_no"), F.when(o == 0, "File | Note | GUID").when(o % 7 == 0, "").otherwise(F.concat(F.lit("m"), F.floor(o / 3).cast("string"), F.lit(".txt | note | "), tail)).alias("value"))


case("s11_parse_manifest", lambda t: records.parse_manifest(manifest_lines(t)), "", rf"""{MANIFEST}, x as (select line_no, trim(split_part(value, '|', 1)) as file, trim(split_part(value, '|', 3)) as last from manifest_lines where value like '%|%'),
    y as (select line_no, file, try_cast(regexp_extract(last, '^([0-9]+)\s*\(int id', 1) as bigint) as fixture_id, last from x), z as (select line_no, file, case when fixture_id is null and regexp_matches(last, '^[0-9A-Fa-f-]{{8,}}$') then upper(last) end as guid, fixture_id from y where lower(file) <> 'file')
    select file, guid, fixture_id from (select *, row_number() over (partition by file order by line_no desc) as r from z where guid is not null or fixture_id is not null) where r = 1""")  # fmt: skip

# ---- rows over records

case("m14_inherit_modes", lambda t: modes.inherit_modes(t("modes").withColumn("parent_idx", F.col("mode_idx") - 1).withColumn("prefix", F.lit(3)), t("mode_rows")), "modes mode_rows", """select doc_id, mode_idx, position, channel_id from mode_rows union all
    select m.doc_id, 1 as mode_idx, r.position, r.channel_id from modes m join mode_rows r on r.doc_id = m.doc_id and r.mode_idx = 0 where m.mode_idx = 1 and r.position <= 3 and not exists (select 1 from mode_rows x where x.doc_id = m.doc_id and x.mode_idx = 1 and x.position = r.position)""")  # fmt: skip
NAMED = r"""heads as (select *, cast(sum(case when head then 1 else 0 end) over w as int) - 1 as mode_idx, count(*) filter (where head) over (partition by doc_id) as k from (select *, coalesce(text like '%DMX Mode' and regexp_matches(lead(text) over (partition by doc_id order by line_no), '^[0-9]+ DMX channels'), false) as head, lead(text) over (partition by doc_id order by line_no) as nxt from named_lines) window w as (partition by doc_id order by line_no)),
    inner_lines as (select * from (select *, count(*) filter (where text = 'FX list') over (partition by doc_id, mode_idx order by line_no) as over_ from heads where k >= 2 and mode_idx >= 0) where over_ = 0),
    named as (select doc_id, mode_idx, 'Level' || case when max(case when head then text end) like 'LEVEL/%' then '/' else ' ' end || regexp_extract(max(case when head then text end), '([0-9]+)', 1) as name, cast(max(case when head then regexp_extract(nxt, '^([0-9]+)', 1) end) as int) as size,
      cast(max(regexp_extract(text, '^Channels 1 - ([0-9]+) as in', 1)) as int) as prefix0, max(regexp_extract(text, 'as in [Ll]evel.([0-9]+) Mode', 1)) as parent from (select doc_id, mode_idx, head, nxt, text from inner_lines) group by 1, 2),
    mm as (select a.doc_id, a.mode_idx, a.name, a.size, case when a.parent = '' then null else a.prefix0 end as prefix, (select max(b.mode_idx) from named b where b.doc_id = a.doc_id and b.mode_idx < a.mode_idx and regexp_extract(b.name, '([0-9]+)', 1) = a.parent) as parent_idx from (select * replace (try_cast(nullif(cast(prefix0 as varchar), '') as int) as prefix0) from named) a),
    own as (select doc_id, mode_idx, position, label from (select l.doc_id, l.mode_idx, cast(regexp_extract(text, '^([0-9]+) ', 1) as int) as position, regexp_extract(text, '[0-9]+-[0-9]+ +(.*)$', 1) as label, row_number() over (partition by l.doc_id, l.mode_idx, cast(regexp_extract(text, '^([0-9]+) ', 1) as int) order by line_no) as r
      from inner_lines l join mm on mm.doc_id = l.doc_id and mm.mode_idx = l.mode_idx where regexp_matches(text, '^[0-9]+ +[0-9]+-[0-9]+ ') and cast(regexp_extract(text, '^([0-9]+) ', 1) as int) between coalesce(mm.prefix, 0) + 1 and mm.size) where r = 1)""".replace("cast(max(regexp_extract(text, '^Channels 1 - ([0-9]+) as in', 1)) as int)", "try_cast(max(regexp_extract(text, '^Channels 1 - ([0-9]+) as in', 1)) as int)").replace("(select * replace (try_cast(nullif(cast(prefix0 as varchar), '') as int) as prefix0) from named) a", "named a")
case("m14_named_modes", lambda t: modes.named_modes(t("named_lines"))[0], "named_lines", f"{NAMED} select doc_id, mode_idx, name, size, parent_idx, prefix from mm")
case("m14_inherited_rows", lambda t: modes.inherit_modes(*modes.named_modes(t.kept("named_lines"))), "named_lines", f"""recursive {NAMED}, up as (select doc_id, mode_idx, mode_idx as a, 100000 as upto, 0 as depth from mm union all select up.doc_id, up.mode_idx, mm.parent_idx, least(upto, prefix), depth + 1 from up join mm on mm.doc_id = up.doc_id and mm.mode_idx = up.a where mm.parent_idx is not null)
    select doc_id, mode_idx, position, label as channel_id from (select up.doc_id, up.mode_idx, position, label, row_number() over (partition by up.doc_id, up.mode_idx, position order by depth) as r from up join own on own.doc_id = up.doc_id and own.mode_idx = up.a where position <= upto) where r = 1""")  # fmt: skip
PARALLEL = r"""ctx as (select *, case when text in ('Single Control Mode', 'Dual Control Mode - Pixels') then text end as c, case when text like '%CH)' then line_no end as g from personality_lines),
    inside as (select * from (select *, last_value(c ignore nulls) over w as of_ctx, last_value(case when c is not null then -1 else g end ignore nulls) over w as grp, count(c) over (partition by doc_id) as several from ctx window w as (partition by doc_id order by line_no)) where several >= 2 and grp > 0),
    heads as (select doc_id, grp, any_value(case of_ctx when 'Single Control Mode' then 'Single Control' else 'Dual Control · Pixels' end) as context, max(case when line_no = grp then text end) as h from inside group by 1, 2),
    top as (select * from (select *, row_number() over (partition by doc_id, grp order by line_no) as k, coalesce(sum(length(text) + 1) over (partition by doc_id, grp order by line_no rows between unbounded preceding and 1 preceding), 0) + 1 as off from inside where line_no > grp) where k <= 9 and off < 500),
    people as (select doc_id, grp, context, unnest(range(len(l))) as personality, unnest(l) as raw from (select *, regexp_extract_all(h, '[A-Z][a-z ]*\([0-9]+CH\)') as l from heads)),
    named as (select doc_id, grp, context, personality, trim(split_part(raw, '(', 1)) as name, cast(regexp_extract(raw, '([0-9]+)CH', 1) as int) as size from people),
    places as (select n.doc_id, n.grp, n.personality, arg_min(instr(lower(t.text), lower(n.name)) - 1 + length(n.name) / 2.0, t.line_no) as place from named n join top t on t.doc_id = n.doc_id and t.grp = n.grp and regexp_matches(lower(t.text), '\b' || lower(n.name) || '\b') group by 1, 2, 3),
    both_ as (select doc_id, grp, count(*) as k, max(place) - min(place) as apart from places group by 1, 2),
    cols as (select n.*, case when b.k = 2 and b.apart >= 2 then cast(rank() over (partition by n.doc_id, n.grp order by p.place) as int) - 1 else n.personality end as col from named n left join places p using (doc_id, grp, personality) left join both_ b using (doc_id, grp))"""
case("m15_personalities", lambda t: modes.contextual_personalities(t("personality_lines")), "personality_lines", f"""{PARALLEL} select doc_id, grp as group_line, context, cast(personality as int) as personality, case name when 'Gamma ray' then 'Gamma Ray' else name end as name, size, cast(col as int) as "column" from cols""")
case("m15_personality_rows", lambda t: modes.personality_rows(t.kept("personality_lines")), "personality_lines", rf"""{PARALLEL}, wide as (select doc_id, grp, count(*) as n from named group by 1, 2),
    cells as (select i.doc_id, i.grp, line_no, regexp_split_to_array(trim(regexp_extract(text, '^((?:(?:[0-9]{{1,3}}|-)\s+)+)[0-9]+-[0-9]+\s', 1)), '\s+') as c, regexp_extract(text, '^(?:(?:[0-9]{{1,3}}|-)\s+)+[0-9]+-[0-9]+\s+(.*)$', 1) as label from inside i where regexp_matches(text, '^((?:(?:[0-9]{{1,3}}|-)\s+)+)[0-9]+-[0-9]+\s')),
    long as (select c.doc_id, c.grp, line_no, label, unnest(range(len(c.c))) as col, unnest(c.c) as cell from cells c join wide using (doc_id, grp) where len(c.c) = n)
    select doc_id, context, case name when 'Gamma ray' then 'Gamma Ray' else name end as name, position, line_no, label from (select l.doc_id, context, name, try_cast(cell as int) as position, line_no, label, row_number() over (partition by l.doc_id, l.grp, personality, try_cast(cell as int) order by line_no) as r from long l join cols using (doc_id, grp, col) where cell <> '-' and try_cast(cell as int) between 1 and size) where r = 1""")  # fmt: skip
GRAMMAR = "case doc_id % 5 when 0 then 'sparse' when 1 then 'coded' when 2 then 'named' when 3 then 'traits' else 'sequential' end"
case("m16_choose_grammar", lambda t: modes.choose_grammar(t("base").select("doc_id", "pk", F.element_at(F.array(*map(F.lit, ["sparse", "coded", "named", "traits", "sequential"])), F.col("pk") % 5 + 1).alias("grammar"))), "base", f"""g as (select doc_id, pk, {GRAMMAR.replace('doc_id', 'pk')} as grammar from base)
    select doc_id, pk, grammar from (select *, rank() over (partition by doc_id order by case grammar when 'named' then 1 when 'sparse' then 3 when 'traits' then 5 when 'sequential' then 6 else 8 end) as r from g) where r = 1""")  # fmt: skip
PARSED = "sizes as (select doc_id, mode_idx, max(channel_offset) as size, count(distinct channel_offset) as parsed, case mode_idx when 0 then 'Basic' else 'Extended' end as name from assignments where channel_offset <= 512 group by 1, 2)"


def parsed_sizes(t: Tables) -> DataFrame:
    return t("assignments").where("channel_offset <= 512").groupBy("doc_id", "mode_idx").agg(F.max("channel_offset").alias("size"), F.count_distinct("channel_offset").alias("parsed")).withColumn("name", F.when(F.col("mode_idx") == 0, "Basic").otherwise("Extended"))


case("m18_reject_thin_tables", lambda t: modes.reject_thin_tables(parsed_sizes(t)), "assignments", f"{PARSED}, w as (select doc_id, size, parsed, row_number() over (partition by doc_id order by size desc, parsed desc) as r from sizes) select * from sizes where doc_id in (select doc_id from w where r = 1 and parsed * 2 >= size)")
SAFETY = "case when kind = 'strobe' and not regexp_matches(lower({0}), 'open|closed|steady|no function|void') then 'strobe' when kind = 'maintenance' and contains(lower({0}), 'reset') then 'reset' else 'normal' end"
case("r14_range_safety", lambda t: t("ranges").join(t("channels").select("doc_id", "channel_id", "channel_idx", "kind"), ["doc_id", "channel_id"]).withColumn("label", F.when(F.col("range_idx") % 2 == 0, "Open").otherwise("Reset lamp")).select("doc_id", "channel_idx", "range_idx", ch.range_safety(F.col("kind"), F.col("label")).alias("safety")), "ranges channels", f"x as (select r.doc_id, channel_idx, range_idx, kind, case when range_idx % 2 = 0 then 'Open' else 'Reset lamp' end as label from ranges r join channels c on c.doc_id = r.doc_id and c.channel_id = r.channel_id) select doc_id, channel_idx, range_idx, {SAFETY.format('label')} as safety from x")
case("r15_merge_channels", lambda t: rows.merge_channels(t("mode_rows").withColumn("position", F.floor((F.col("position") + 1) / 2))), "mode_rows", """x as (select *, floor((position + 1) / 2) as p from mode_rows)
    select doc_id, mode_idx, cast(p as bigint) as position, name, kind, channel_id, n as n_rows from (select *, count(*) over (partition by doc_id, mode_idx, p) as n, row_number() over (partition by doc_id, mode_idx, p order by case when kind = 'generic' then 1 else 0 end, channel_idx) as r from x) where r = 1""")  # fmt: skip
case("r15_distinct_ranges", lambda t: rows.distinct_ranges(t("ranges")), "ranges", "select doc_id, channel_id, range_idx, range_start, range_end, name, safety, confidence from (select *, row_number() over (partition by doc_id, channel_id, range_start, range_end order by range_idx) as r from ranges) where r = 1")
case("r16_drop_overlapping_ranges", lambda t: rows.drop_overlapping_ranges(t("ranges")), "ranges", """recursive n as (select doc_id, channel_id, range_idx, range_start, range_end, row_number() over (partition by doc_id, channel_id order by range_idx) as i from ranges where range_start <= range_end),
    walk as (select doc_id, channel_id, i, range_idx, range_start, range_end, true as keep, [struct_pack(a := range_start, b := range_end)] as kept from n where i = 1
      union all select n.doc_id, n.channel_id, n.i, n.range_idx, n.range_start, n.range_end, len(list_filter(w.kept, lambda k: k.a <= n.range_end and n.range_start <= k.b)) = 0,
        case when len(list_filter(w.kept, lambda k: k.a <= n.range_end and n.range_start <= k.b)) = 0 then list_append(w.kept, struct_pack(a := n.range_start, b := n.range_end)) else w.kept end from walk w join n on n.doc_id = w.doc_id and n.channel_id = w.channel_id and n.i = w.i + 1)
    select doc_id, channel_id, range_idx, range_start, range_end from walk where keep""")  # fmt: skip
FILLED = """holes as (select * from mode_rows where position % 3 > 0 or position = 3), sized as (select doc_id, mode_idx, max(position) as size, count(distinct position) as parsed from holes group by 1, 2),
    filled as (select s.doc_id, s.mode_idx, p.position, s.parsed, coalesce(h.name, 'Channel ' || p.position) as name, coalesce(h.confidence, 0.25) as confidence from sized s, lateral (select unnest(range(1, s.size + 1)) as position) p left join holes h on h.doc_id = s.doc_id and h.mode_idx = s.mode_idx and h.position = p.position)"""


def holes(t: Tables) -> DataFrame:
    return t("mode_rows").where("position % 3 > 0 or position = 3")


case("r17_fill_missing_positions", lambda t: rows.fill_missing_positions(holes(t)).select("doc_id", "mode_idx", "position", "parsed", "name", "confidence"), "mode_rows", f"{FILLED} select doc_id, mode_idx, cast(position as int) as position, parsed, name, confidence from filled")
case("r18_pair_fine_channels", lambda t: rows.pair_fine_channels(t("mode_rows")), "mode_rows", r"""x as (select *, regexp_matches(name, '(?i)\b(fine|lsb|16.?bit)\b') as f from mode_rows), y as (select *, lag(name) over w as pn, lag(kind) over w as pk, lag(color) over w as pc, lag(channel_id) over w as pi, lag(f) over w as pf from x window w as (partition by doc_id, mode_idx order by position, channel_idx)),
    z as (select *, coalesce(f and not pf and pk = kind, false) as l from y)
    select doc_id, mode_idx, position, channel_idx, case when l then pn || ' fine' else name end as name, case when l then pc else color end as color, case when l then pi end as fine_of from z""")  # fmt: skip
SPARSE = """select m.doc_id, m.mode_idx, m.position, m.channel_idx, case when m.name = 'Dimmer fine' then 'Fine dimmer' when m.name like 'Green%' then 'Zoom' else m.name end as name, case when m.name = '255' then 'generic' when m.name like 'Green%' then 'zoom' else m.kind end as kind, m.color, m.confidence, case when m.name = 'Dimmer fine' then null else c.fine_of end as fine_of
    from mode_rows m join channels c on c.doc_id = m.doc_id and c.channel_idx = m.channel_idx where m.position % 3 > 0 or m.position = 3"""


def sparse_rows(t: Tables) -> DataFrame:
    """Mode rows with holes, with fine links, bare numbers and a zoom."""
    m = t("mode_rows").where("position % 3 > 0 or position = 3").join(t("channels").select("doc_id", "channel_idx", "fine_of"), ["doc_id", "channel_idx"])
    green, fine = F.col("name").startswith("Green"), F.col("name") == "Dimmer fine"
    kind = F.when(F.col("name") == "255", "generic").when(green, "zoom").otherwise(F.col("kind"))
    return m.withColumn("kind", kind).withColumn("fine_of", F.when(~fine, F.col("fine_of"))).withColumn("name", F.when(fine, "Fine dimmer").when(green, "Zoom").otherwise(F.col("name")))


case("r19_infer_fine_gaps", lambda t: rows.infer_fine_gaps(rows.fill_missing_positions(sparse_rows(t))).select("doc_id", "mode_idx", "position", "name", "kind", "inferred"), "mode_rows channels", f"""recursive sp as ({SPARSE}), sized as (select doc_id, mode_idx, max(position) as size from sp group by 1, 2),
    firsts as (select doc_id, mode_idx, position, arg_min({{'name': name, 'kind': kind, 'fine_of': fine_of}}, channel_idx) as f from sp group by 1, 2, 3),
    cells as (select s.doc_id, s.mode_idx, cast(p.position as int) as position, coalesce(f.name, 'Channel ' || p.position) as name, f.kind as kind, f.fine_of as fine_of, lead(f.kind) over (partition by s.doc_id, s.mode_idx order by p.position) as next_kind from sized s, lateral (select unnest(range(1, s.size + 1)) as position) p left join firsts h on h.doc_id = s.doc_id and h.mode_idx = s.mode_idx and h.position = p.position),
    walk as (select doc_id, mode_idx, position, name, kind, false as inferred, kind is not null and fine_of is null and kind in ('colorIntensity', 'intensity', 'pan', 'tilt', 'zoom') as coarse from cells where position = 1
      union all select c.doc_id, c.mode_idx, c.position, case when w.coarse and c.hit then w.name || ' fine' else c.name end, case when w.coarse and c.hit then w.kind else c.kind end, w.coarse and c.hit, not (w.coarse and c.hit) and c.kind is not null and c.fine_of is null and c.kind in ('colorIntensity', 'intensity', 'pan', 'tilt', 'zoom')
      from walk w join (select *, case when kind is null then next_kind is not null else fine_of is not null or lower(name) like 'fine %' or (kind = 'generic' and regexp_matches(name, '^[0-9]{{1,3}}$')) end as hit from cells) c on c.doc_id = w.doc_id and c.mode_idx = w.mode_idx and c.position = w.position + 1)
    select doc_id, mode_idx, position, name, kind, inferred from walk""")  # fmt: skip
REL = "kind || case when color <> '' then ':' || color else '' end || case when regexp_extract(name, '([0-9]{1,3})', 1) <> '' then ':' || regexp_extract(name, '([0-9]{1,3})', 1) else '' end"
case("r20_relationship_key", lambda t: t("channels").select("doc_id", "channel_idx", ch.relationship_key(F.col("kind"), F.col("color"), F.col("name")).alias("rel_key")), "channels", f"select doc_id, channel_idx, {REL} as rel_key from channels")
case("r21_resolve_fine_of", lambda t: rows.resolve_fine_of(t("mode_rows")), "mode_rows", rf"""x as (select *, regexp_matches(name, '(?i)\b(fine|lsb)\b') as f, {REL} as rel_key from mode_rows)
    select doc_id, mode_idx, position, channel_idx, rel_key, coarse_id from (select *, last_value(case when not f then channel_id end ignore nulls) over (partition by doc_id, mode_idx, rel_key order by position, channel_idx rows between unbounded preceding and 1 preceding) as coarse_id from x) where f""")  # fmt: skip
case("r22_guard_value_bleed", lambda t: rows.guard_value_bleed(t("mode_rows").select("doc_id", "mode_idx", "position", "name")), "mode_rows", "select doc_id, mode_idx, position, case when regexp_matches(name, '^[0-9]+$') then 'Channel ' || position else name end as name from mode_rows")
case("r23_expand_rgb_blocks", lambda t: rows.expand_rgb_blocks(t("base").where("r = 1").select("doc_id", F.col("ln").alias("first"), F.concat(F.col("n").cast("string"), F.lit(" x RGB"), F.when(F.col("pk") % 2 == 0, "W").otherwise(""), F.lit(" = "), (F.col("n") * F.when(F.col("pk") % 4 == 0, 4).otherwise(3)).cast("string"), F.lit(" channels")).alias("text"))), "base", """b as (select doc_id, ln as first, n, case when pk % 2 = 0 then 4 else 3 end as width, n * case when pk % 4 = 0 then 4 else 3 end as m from base where r = 1),
    g as (select * from b where n * width = m), s as (select doc_id, first, width, unnest(range(1, n + 1)) as seg from g), k as (select *, unnest(range(0, width)) as k from s)
    select doc_id, cast(first + (seg - 1) * width + k as int) as position, ['Red', 'Green', 'Blue', 'White'][k + 1] || ' ' || seg as name from k""")  # fmt: skip
SERIES = "series as (select doc_id, color, zone, min(position) as position from (select doc_id, case when pk % 2 = 0 then 'RED' else 'BLUE' end as color, ln as zone, ln * 3 + case when pk % 29 = 0 then 1 else 0 end as position from base) group by 1, 2, 3)"


def series(t: Tables) -> DataFrame:
    return t("base").select("doc_id", F.when(F.col("pk") % 2 == 0, "RED").otherwise("BLUE").alias("color"), F.col("ln").alias("zone"), (F.col("ln") * 3 + F.when(F.col("pk") % 29 == 0, 1).otherwise(0)).alias("position")).groupBy("doc_id", "color", "zone").agg(F.min("position").alias("position"))


BLOCKS = "select doc_id, sk % 2 as mode_idx, 3 * n + ln as size, case pk % 4 when 0 then concat(cast(n as string), ' x RGB channels = ', cast(3 * n as string), ' channels for individual RGB Beam pixel') when 1 then concat(cast(3 * n as string), ' channels for individual RGB control of all ', cast(n as string), ' Aura pixels') when 2 then concat(cast(n * 40 as string), ' channels for Aura control in segments') else 'no pixels' end as text from base where r = 1"


def pixel_sections(t: Tables) -> DataFrame:
    sections = BLOCKS.removeprefix("select ").partition(" from base")[0]
    return t("base").where("r = 1").selectExpr(*[x.strip() for x in re.split(r", (?=sk %|3 \* n \+|case pk)", sections)])


case("r23_pixel_templates", lambda t: rows.pixel_templates(pixel_sections(t)), "base", f"""b as ({BLOCKS.replace('as string', 'as varchar')}), x as (select doc_id, mode_idx, size, case when text like '%Beam%' then 'Beam pixel ' when text like '%of all%' then 'Aura pixel ' end as label, case when text like '%Beam%' then cast(split_part(text, ' ', 6) as int) else cast(split_part(text, ' ', 1) as int) end as m from b where text <> 'no pixels'),
    k as (select *, unnest(range(1, m // 3 + 1)) as k from x), c as (select *, unnest(['Red', 'Green', 'Blue']) as color, unnest([0, 1, 2]) as o from k)
    select doc_id, mode_idx, cast(size - m + 1 + (k - 1) * 3 + o as int) as position, coalesce(label || k, case when k <= 37 then 'Aura pixels around Beam pixel ' || k when k = 38 then 'Inner Aura ring' when k = 39 then 'Second Aura ring' else 'Aura segment ' || k end) || ' ' || color as name from c""")  # fmt: skip
case("r24_fill_color_series", lambda t: rows.fill_color_series(series(t)), "base", f"""{SERIES}, o as (select *, row_number() over (partition by doc_id, color order by zone) as k from series), tt as (select a.doc_id, a.color, a.zone as z1, a.position as p1, (b.position - a.position) / (b.zone - a.zone) as stride from o a join o b on a.doc_id = b.doc_id and a.color = b.color and a.k = 1 and b.k = 2 where (b.position - a.position) % (b.zone - a.zone) = 0),
    fit as (select doc_id, color, z1, p1, stride, max(zone) as top from series join tt using (doc_id, color) group by all having bool_and(position = p1 + (zone - z1) * stride) and stride > 0), every as (select doc_id, color, z1, p1, stride, unnest(range(z1, top + 1)) as zone from fit)
    select doc_id, color, cast(zone as int) as zone, cast(p1 + (zone - z1) * stride as int) as position from every e where not exists (select 1 from series s where s.doc_id = e.doc_id and s.color = e.color and s.zone = e.zone)""")  # fmt: skip


def dotted(t: Tables) -> DataFrame:
    b = t("base").where("r <= 3")
    return b.select("doc_id", F.col("r").alias("ord"), F.when(F.col("r") == 1, 1).when(F.col("r") == 3, 1 + F.col("ln")).alias("block"), F.when(F.col("r") == 1, 1).when(F.col("r") == 3, 1 + F.col("ln") * F.when(F.col("pk") % 3 == 0, 5).otherwise(4)).alias("first"), F.lit(4).alias("size"))


case("r25_expand_ellipsis", lambda t: rows.expand_ellipsis(dotted(t)), "base", """b as (select doc_id, ln as m, 1 + ln * case when pk % 3 = 0 then 5 else 4 end as first from base where r = 3), g as (select * from b where m > 1 and first = 1 + m * 4), e as (select doc_id, unnest(range(1, m)) as i from g)
    select doc_id, cast(1 + i as int) as block, cast(1 + i * 4 as int) as first, 4 as size from e""")  # fmt: skip
case("r30_default_ranges", lambda t: rows.default_ranges(t("channels"), t("ranges").where("range_start % 3 = 0")), "channels ranges", """select doc_id, channel_idx, channel_id, 0 as range_start, 255 as range_end, case when kind = 'intensity' then 'Brightness' else 'Full range' end as name, case kind when 'strobe' then 'strobe' when 'maintenance' then 'reset' else 'normal' end as safety, cast(case when kind in ('strobe', 'maintenance') then 0.45 else 0.8 end as double) as confidence
    from channels c where not exists (select 1 from ranges r where r.doc_id = c.doc_id and r.channel_id = c.channel_id and r.range_start % 3 = 0)""")  # fmt: skip
def some_ranges(t: Tables) -> DataFrame:
    """Ranges, and a default one for channels without any that starts at a multiple of 3."""
    few = t("ranges").where("range_start % 3 = 0")
    return few.select("doc_id", "channel_id", "range_start", "range_end").unionByName(rows.default_ranges(t("channels"), few).select("doc_id", "channel_id", "range_start", "range_end"))


def lit_channels(t: Tables) -> DataFrame:
    return t("channels").withColumn("name", F.when(F.col("name") == "Red", "Virtual color wheel").when(F.col("name") == "Tilt", "Shutter / Strobe").otherwise(F.col("name")))


case("r29_appendix_of_channels", lambda t: rows.attach_appendix(rows.appendix_sections(t("appendix_lines")), lit_channels(t), some_ranges(t)), "appendix_lines channels ranges", r"""few as (select doc_id, channel_id, range_start, range_end from ranges where range_start % 3 = 0),
    sr as (select * from few union all select doc_id, channel_id, 0, 255 from channels c where not exists (select 1 from few where few.doc_id = c.doc_id and few.channel_id = c.channel_id)),
    one as (select doc_id, channel_id from sr group by 1, 2 having count(*) = 1 and min(range_start) = 0 and max(range_end) = 255),
    keyed as (select c.doc_id, c.channel_idx, c.channel_id, case when c.name = 'Red' then 'wheel' when c.name = 'Tilt' or (c.kind = 'strobe' and one.doc_id is not null) then 'shutter' end as key from channels c left join one on one.doc_id = c.doc_id and one.channel_id = c.channel_id),
    marks as (select doc_id, min(case when text = 'Shutter' then line_no end) as s, min(case when text in ('Mode table 2', 'MODE  TABLE ②') then line_no end) as e, min(case when text = 'Virtual colour wheel*' then line_no end) as vs, min(case when text = '12   Zoom' then line_no end) as ve from appendix_lines group by 1),
    parts as (select l.doc_id, case when line_no > s and line_no < e then 'shutter' when line_no > vs and line_no < ve then 'wheel' end as key, line_no, text from appendix_lines l join marks using (doc_id)),
    read as (select doc_id, key, line_no, try_cast(regexp_extract(text, '^(?:[0-9]{1,3}\s+)?([0-9]{1,3})\s*[-–]\s*([0-9]{1,3})\s+(.+?)\s*$', 1) as int) as a, try_cast(regexp_extract(text, '^(?:[0-9]{1,3}\s+)?([0-9]{1,3})\s*[-–]\s*([0-9]{1,3})\s+(.+?)\s*$', 2) as int) as b, regexp_replace(regexp_extract(text, '^(?:[0-9]{1,3}\s+)?([0-9]{1,3})\s*[-–]\s*([0-9]{1,3})\s+(.+?)\s*$', 3), '[ .]+$', '') as name from parts where key is not null and regexp_matches(text, '^(?:[0-9]{1,3}\s+)?([0-9]{1,3})\s*[-–]\s*([0-9]{1,3})\s+(.+?)\s*$'))
    select k.doc_id, channel_idx, channel_id, line_no, a as range_start, b as range_end, name, case when name = 'Strobe fast' then 'strobe' else 'normal' end as safety, cast(0.95 as double) as confidence from keyed k join read r on r.doc_id = k.doc_id and r.key = k.key where a <= b and b <= 255 and name <> 'Page 7'""")  # fmt: skip
case("r32_assign_ids", lambda t: rows.assign_ids(t("channels")), "channels", """select doc_id, channel_idx, case when k > 1 then channel_id || '-' || lpad(cast(k as varchar), 2, '0') else channel_id end as channel_id, case when k > 1 then name || ' (' || k || ')' else name end as name from (select *, row_number() over (partition by doc_id, channel_id order by channel_idx) as k from channels)""")
case("r33_split_breaks", lambda t: rows.split_breaks(t("base").select("doc_id", "r", (F.col("pk") * 7).alias("slot"))), "base", "select doc_id, r, pk * 7 as slot, cast(floor(pk * 7 / 512) as int) + 1 as dmx_break, (pk * 7) % 512 + 1 as channel_offset from base")
case("r34_unstructured_modes", lambda t: rows.unstructured_modes(t("base").select("doc_id", (F.col("sk") % 6 + 1).alias("size")).distinct(), t("channels")), "base channels", "s as (select distinct doc_id, sk % 6 + 1 as size from base) select doc_id, size || '-channel' as mode_name, channel_idx + 1 as position, channel_id from s join channels using (doc_id) where channel_idx + 1 <= size")

# ---- classification

case("c1_classify_channels", lambda t: t("channels").withColumn("c", ch.classify(F.col("name"))).select("doc_id", "channel_idx", "c.name", "c.kind", "c.color", "c.fine_of"), "channels", r"""x as (select doc_id, channel_idx, name, regexp_replace(lower(name), '\blsb\b', 'fine') as d, regexp_extract(name, '([0-9]+)', 1) as z from channels)
    select doc_id, channel_idx, case d when 'pan' then 'Pan' when 'pan fine' then 'Pan fine' when 'tilt' then 'Tilt' when 'tilt fine' then 'Tilt fine' when 'dimmer' then 'Dimmer' when 'dimmer fine' then 'Dimmer fine' when 'red' then 'Red' when 'red fine' then 'Red fine' when 'strobe' then 'Light switch / strobe' when 'gobo wheel' then 'Gobo wheel' when 'color wheel' then 'Color wheel' when 'reset' then 'Reset / function' when 'program speed' then 'Program speed' else case when d like 'green %' then 'Green ' || z else name end end as name,
      case when d like 'pan%' then 'pan' when d like 'tilt%' then 'tilt' when d like 'dimmer%' then 'intensity' when d like 'red%' or d like 'green%' then 'colorIntensity' when d = 'strobe' then 'strobe' when d = 'gobo wheel' then 'goboWheel' when d = 'color wheel' then 'colorWheel' when d = 'reset' then 'maintenance' when d = 'program speed' then 'speed' else 'generic' end as kind,
      case when d like 'red%' and d <> 'reset' then 'RED' when d like 'green%' then 'GREEN' else '' end as color, case d when 'pan fine' then 'pan' when 'tilt fine' then 'tilt' when 'dimmer fine' then 'intensity:dimmer' when 'red fine' then 'colorIntensity:RED:' else '' end as fine_of from x""".replace("when d like 'red%' or d like 'green%'", "when d in ('red', 'red fine') or d like 'green%'"))  # fmt: skip
KEY = "regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g')), ' [0-9]+$', ''), ' (fine|lsb|16 bit)$', '')"
TEMPLATE = "case when regexp_matches({0}, '^[A-Za-z0-9_]+$') then regexp_replace({0}, '^([A-Za-z_]*?)[0-9]+', '\\1(n)') end"
POOL = f"""votes as (select pretty, attribute, source, count(*) as n from truth_channels join truth_modes using (mode_id) join truth_fixtures using (fixture_id) where pretty is not null and attribute is not null group by 1, 2, 3),
    keyed as (select * from (select {KEY.format('pretty')} as key, {TEMPLATE.format('attribute')} as template, source, n from votes) where length(key) >= 2 and template is not null),
    sums as (select *, sum(case when source = 'library' then n else 0 end) over (partition by key) as own, sum(n) over (partition by key) as every from keyed),
    pooled as (select key, template, sum(n) as n from sums where (own >= 20 and source = 'library') or (own < 20 and every >= 300) group by 1, 2), pool as (select * from (select *, sum(n) over (partition by key) as total from pooled) where total >= 50),
    mapped as (select key, template, total, round(n / total, 6) as ratio from (select *, row_number() over (partition by key order by n desc, template desc) as r from pool) where r = 1 and template <> 'NoFeature' and n / total >= 0.6)"""


def pool(t: Tables) -> DataFrame:
    return catalog.vote_pool(catalog.attribute_votes(t("truth_channels"), t("truth_modes"), t("truth_fixtures")))


def mapped(t: Tables) -> DataFrame:
    return catalog.majority_template(pool(t), 0.6)


TRUTH = "truth_channels truth_modes truth_fixtures"
TAXONOMY = [("Dimmer", "Dimmer.Dimmer"), ("Pan", "Position.PanTilt"), ("Gobo(n)Pos", "Gobo.Gobo"), ("Shutter(n)", "Beam.Beam"), ("ColorAdd_R", "Color.RGB"), ("Gobo(n)Pos(m)", "Gobo.Gobo")]
TAX_SQL = "taxonomy(name, feature, ord) as (values " + ", ".join(f"('{n}', '{f}', {i})" for i, (n, f) in enumerate(TAXONOMY)) + ")"


def taxonomy(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(n, f, i) for i, (n, f) in enumerate(TAXONOMY)], "name string, feature string, ord int")


case("c2_lookup_attribute", lambda t: catalog.lookup_attribute(t("channels").select("doc_id", "channel_idx", "name"), mapped(t)), f"channels {TRUTH}", f"{POOL} select doc_id, channel_idx, name, replace(template, '(n)', coalesce(cast(try_cast(regexp_extract(name, '([0-9]+)', 1) as int) as varchar), '1')) as attribute from channels left join mapped on mapped.key = {KEY.format('name')}")
KINDS = ", ".join(f"'{k}'" for k in ch.KINDS)
case("c3_fold_kind", lambda t: t("channels").select("doc_id", "channel_idx", ch.fold_kind(F.col("kind")).alias("kind")), "channels", f"select doc_id, channel_idx, case when kind in ({KINDS}) then kind when kind in ('frost', 'shaper', 'blade', 'animation', 'macro', 'laser', 'fog') then 'effect' else 'generic' end as kind from channels")
ATTR = "case when kind = 'colorIntensity' and color = 'RED' then 'ColorAdd_R' when kind = 'colorIntensity' and color = 'GREEN' then 'ColorAdd_G' when kind = 'pan' then 'Pan' when kind = 'tilt' then 'Tilt' when kind = 'intensity' then 'Dimmer' when kind = 'strobe' then 'Shutter1' when kind = 'colorWheel' then 'Color1' when kind = 'goboWheel' then 'Gobo1' when kind = 'speed' then 'EffectsSpeed' when kind = 'maintenance' then 'FixtureGlobalReset' else 'NoFeature' end"
FEAT = "case when kind in ('intensity', 'strobe') then 'Dimmer' when kind in ('pan', 'tilt') then 'Position' when kind in ('colorIntensity', 'colorWheel') then 'Color' when kind = 'goboWheel' then 'Gobo' else 'Control' end"
case("c4_default_attribute", lambda t: t("channels").select("doc_id", "channel_idx", ch.default_attribute(F.col("kind"), F.col("color")).alias("attribute")), "channels", f"select doc_id, channel_idx, {ATTR} as attribute from channels")
case("c5_match_taxonomy", lambda t: catalog.match_taxonomy(t("truth_channels"), taxonomy(t)), "truth_channels", rf"""{TAX_SQL}, a as (select distinct attribute, regexp_replace(regexp_replace(attribute, '^([^0-9]*)[0-9]+', '\1(n)'), '^([^0-9]*\(n\)[^0-9]*)[0-9]+', '\1(m)') as tt from truth_channels) select attribute, name, feature from a left join taxonomy on name = tt""")
case("c6_kind_for_attribute", lambda t: t("truth_channels").select("channel_id", ch.kind_for_attribute(F.col("attribute")).alias("kind")), "truth_channels", "select channel_id, case when attribute like 'Pan%' then 'pan' when attribute like 'Dimmer%' then 'intensity' when attribute like 'Shutter%' then 'strobe' when attribute like 'ColorAdd%' then 'colorIntensity' when attribute like 'Gobo%' then 'goboWheel' else 'generic' end as kind from truth_channels")
case("c7_feature_default", lambda t: t("channels").select("doc_id", "channel_idx", ch.feature_default(F.col("kind"), F.col("gdtf_attribute")).alias("feature")), "channels", f"select doc_id, channel_idx, case when gdtf_attribute <> '' then gdtf_attribute else {FEAT} end as feature from channels")

# ---- catalogs

case("k1_brand_counts", lambda t: catalog.brand_counts(t("makers")), "makers", "select maker, count(*) as n from makers group by 1")
case("k2_brand_key", lambda t: t("makers").select("pk", tx.brand_key(F.col("maker")).alias("key")), "makers", "select pk, trim(regexp_replace(lower(maker), '[^a-z0-9]+', ' ', 'g')) as key from makers")
BRAND = """bc as (select name, sum(n) as n, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as key from (select trim(maker) as name, count(*) as n from makers group by 1) where length(name) >= 3 group by 1),
    br as (select *, row_number() over (partition by key order by n desc, name) as r from bc where key <> 'brand 3'), brands as (select max(case when r = 1 then name end) as canonical, coalesce(string_agg(case when r > 1 then name end, '|' order by name), '') as aliases, key in ('brand 5') as requires_strong_signal from br group by key)"""


def brands(t: Tables) -> DataFrame:
    one = lambda k: t.spark.createDataFrame([(k,)], "key string")
    return catalog.build_brand_catalog(catalog.brand_counts(t("makers")), one("brand 3"), one("brand 5"))


case("k3_build_brand_catalog", lambda t: brands(t).withColumn("aliases", F.array_join("aliases", "|")), "makers", f"{BRAND} select * from brands")
case("k4_attribute_votes", lambda t: catalog.attribute_votes(t("truth_channels"), t("truth_modes"), t("truth_fixtures")), TRUTH, f"{POOL} select * from votes")
case("k5_attribute_key", lambda t: t("truth_channels").select("channel_id", tx.attribute_key(F.col("pretty")).alias("key")), "truth_channels", f"select channel_id, {KEY.format('pretty')} as key from truth_channels")
case("k6_attribute_template", lambda t: t("truth_channels").select("channel_id", tx.attribute_template(F.col("attribute")).alias("template")), "truth_channels", f"select channel_id, {TEMPLATE.format('attribute')} as template from truth_channels")
case("k7_vote_pool", pool, TRUTH, f"{POOL} select key, template, n, total from pool")
case("k8_majority_template", mapped, TRUTH, f"{POOL} select * from mapped")
case("k9_validate_templates", lambda t: catalog.validate_templates(mapped(t), taxonomy(t)), TRUTH, f"{POOL}, {TAX_SQL} select key, template, total, ratio from mapped where template in (select name from taxonomy)")

# ---- ranges and rules

SORTED = "(partition by doc_id, channel_id order by range_start, range_idx)"
REACH = "coalesce(max(range_end) over (partition by doc_id, channel_id order by range_start, range_idx rows between unbounded preceding and 1 preceding), -1)"
case("v1_covers_full", lambda t: validate.covers_full(t("ranges")), "ranges", f"x as (select *, {REACH} as reach from ranges) select doc_id, channel_id, bool_and(range_start <= reach + 1) and max(range_end) >= 255 as covers from x group by 1, 2")
case("v2_complete_ranges", lambda t: validate.complete_ranges(t("channels"), t("ranges")), "channels ranges", f"""x as (select *, {REACH} as reach from ranges where range_start <= range_end), tops as (select doc_id, channel_id, max(range_end) as top from x group by 1, 2)
    select doc_id, channel_id, greatest(range_start, reach + 1) as range_start, range_end, name from x where range_end > reach
    union all select doc_id, channel_id, reach + 1, range_start - 1, 'Unspecified' from x where range_start > reach + 1 union all select doc_id, channel_id, top + 1, 255, 'Unspecified' from tops where top < 255
    union all select distinct doc_id, channel_id, 0, 255, 'Full range' from channels c where not exists (select 1 from tops where tops.doc_id = c.doc_id and tops.channel_id = c.channel_id)""")  # fmt: skip
case("v3_scale_16bit", lambda t: validate.scale_16bit(t("ranges")).select("doc_id", "channel_id", "range_idx", "wide_start", "wide_end"), "ranges", "select doc_id, channel_id, range_idx, range_start * 257 as wide_start, case when range_end = 255 then 65535 else (range_end + 1) * 257 - 1 end as wide_end from ranges")
case("v4_risky_range", lambda t: validate.risky_range(t("channels").select("doc_id", "channel_id", (F.col("channel_idx") * 40 % 256).alias("value")).distinct(), t("ranges")), "channels ranges", """v as (select distinct doc_id, channel_id, channel_idx * 40 % 256 as value from channels) select doc_id, channel_id, value, range_idx, safety from (select v.*, r.range_idx, r.safety, row_number() over (partition by v.doc_id, v.channel_id, v.value order by r.range_idx) as k from v join ranges r on r.doc_id = v.doc_id and r.channel_id = v.channel_id and r.safety <> 'normal' and v.value between r.range_start and r.range_end) where k = 1""")
RP = "channel_id || '.ranges[' || p || ']'"
RS = f"rs as (select *, row_number() over {SORTED} - 1 as p, lag(range_end) over {SORTED} as e from ranges)"
SLOT = "'modes[' || mode_idx || '].channels[' || slot_idx || ']'"
RULES = {
    "v5_identity": ("fixtures", "select doc_id, 'error' as level, 'identity.manufacturer' as code, 'identity.manufacturer' as path, 'manufacturer is blank' as message from fixtures where trim(manufacturer) = '' union all select doc_id, 'error', 'identity.model', 'identity.model', 'model is blank' from fixtures where trim(model) = ''"),
    "v6_no_modes": ("fixtures modes", "select doc_id, 'error' as level, 'modes.none' as code, 'modes' as path, 'no modes' as message from fixtures where doc_id not in (select doc_id from modes)"),
    "v7_duplicate_channel": ("channels", "select doc_id, 'error' as level, 'channel.duplicate' as code, 'channels[' || channel_idx || ']' as path, 'duplicate id ' || channel_id as message from (select *, row_number() over (partition by doc_id, channel_id order by channel_idx) as k from channels) where k > 1"),
    "v8_range_reversed": ("ranges", f"{RS} select doc_id, 'error' as level, 'range.reversed' as code, {RP} as path, 'start is after end' as message from rs where range_start > range_end"),
    "v9_range_overlap": ("ranges", f"{RS} select doc_id, 'error' as level, 'range.overlap' as code, {RP} as path, 'overlaps the range before' as message from rs where range_start <= e"),
    "v10_range_uncertain": ("ranges", f"{RS} select doc_id, 'warning' as level, 'range.uncertain' as code, {RP} as path, 'low confidence' as message from rs where confidence < 0.6"),
    "v11_safety_unnamed": ("ranges", f"{RS} select doc_id, 'warning' as level, 'range.safety' as code, {RP} as path, 'safety without a name' as message from rs where safety <> 'normal' and trim(name) = ''"),
    "v12_fine_missing": ("channels", "select doc_id, 'error' as level, 'channel.fine' as code, 'channels[' || channel_idx || ']' as path, 'fine of absent ' || fine_of as message from channels c where fine_of is not null and not exists (select 1 from channels d where d.doc_id = c.doc_id and d.channel_id = c.fine_of)"),
    "v13_unknown_channel": ("assignments channels", f"select doc_id, 'error' as level, 'slot.channel' as code, {SLOT} as path, 'absent channel ' || channel_id as message from assignments a where not exists (select 1 from channels c where c.doc_id = a.doc_id and c.channel_id = a.channel_id)"),
    "v14_offset": ("assignments", f"select doc_id, 'error' as level, 'slot.offset' as code, {SLOT} as path, 'offset ' || channel_offset as message from assignments where channel_offset not between 1 and 512"),
    "v15_break": ("assignments modes", f"select doc_id, 'error' as level, 'slot.break' as code, {SLOT} as path, 'break ' || dmx_break as message from assignments join modes using (doc_id, mode_idx) where dmx_break < 1 or dmx_break > greatest(breaks, 1)"),
    "v16_slot_overlap": ("assignments", f"select doc_id, 'error' as level, 'slot.overlap' as code, {SLOT} as path, 'already held by ' || h as message from (select *, lag(channel_id) over (partition by doc_id, mode_idx, dmx_break, channel_offset order by slot_idx) as h from assignments) where h is not null"),
}
RULE_FN = {"v5_identity": validate.v_identity, "v6_no_modes": validate.v_no_modes, "v7_duplicate_channel": validate.v_duplicate_channel, "v8_range_reversed": validate.v_range_reversed, "v9_range_overlap": validate.v_range_overlap, "v10_range_uncertain": validate.v_range_uncertain, "v11_safety_unnamed": validate.v_safety_unnamed, "v12_fine_missing": validate.v_fine_missing, "v13_unknown_channel": validate.v_unknown_channel, "v14_offset": validate.v_offset, "v15_break": validate.v_break, "v16_slot_overlap": validate.v_slot_overlap}
for _name, (_needs, _sql) in RULES.items():
    case(_name, lambda t, f=RULE_FN[_name], n=_needs: f(*[t(x) for x in n.split()]), _needs, _sql)
RECORD = "fixtures channels ranges modes assignments"
MATRIX = "select doc_id, 'warning' as level, 'matrix.count' as code, 'matrix' as path, (pk % 6) || ' pixels' as message from base where r = 1 and pk % 6 > 0 and pk % 6 <> (pk % 4 + 1) * (sk % 3 + 1)"
ISSUES = f"{RS}, issues as (" + " union all ".join(f"select * from ({s.removeprefix(RS).strip()})" for s in [*(s for _, s in RULES.values()), MATRIX]) + ")"


def matrices(t: Tables) -> DataFrame:
    return t("base").where("r = 1").select("doc_id", (F.col("pk") % 4 + 1).alias("x"), (F.col("sk") % 3 + 1).alias("y"), F.lit(0).alias("z"), (F.col("pk") % 6).alias("n_pixels"))


def issues(t: Tables) -> DataFrame:
    return validate.validate(*[t(x) for x in RECORD.split()], matrices(t))


case("v17_matrix_count", lambda t: validate.v_matrix_count(matrices(t)), "base", MATRIX)
case("v18_validate", issues, RECORD, f"{ISSUES} select * from issues")
case("v19_exportable", lambda t: validate.exportable(t("fixtures"), issues(t)).select("doc_id"), RECORD, f"{ISSUES} select doc_id from fixtures where doc_id not in (select doc_id from issues where level = 'error')")
case("flagship_report", lambda t: t("fixtures").select("doc_id", "manufacturer", "model").join(validate.covers_full(t("ranges")).groupBy("doc_id").agg(F.count("*").alias("n_channels"), F.count_if("covers").alias("n_covered")), "doc_id").join(issues(t).groupBy("doc_id").agg(F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings")), "doc_id", "left").na.fill(0, ["n_errors", "n_warnings"]), RECORD, f"""{ISSUES}, x as (select *, {REACH} as reach from ranges), cv as (select doc_id, channel_id, bool_and(range_start <= reach + 1) and max(range_end) >= 255 as covers from x group by 1, 2), cc as (select doc_id, count(*) as n_channels, count(*) filter (where covers) as n_covered from cv group by 1),
    ic as (select doc_id, count(*) filter (where level = 'error') as n_errors, count(*) filter (where level = 'warning') as n_warnings from issues group by 1)
    select doc_id, manufacturer, model, n_channels, n_covered, coalesce(n_errors, 0) as n_errors, coalesce(n_warnings, 0) as n_warnings from fixtures join cc using (doc_id) left join ic using (doc_id)""")  # fmt: skip
WHEEL_KINDS = "wk as (select doc_id, case when sk % 2 = 0 then 'color' else 'gobo' end as kind, (pk % 10) / 10.0 as confidence from base where r <= 2)"
QUEUE = f"""{PARSED}, {WHEEL_KINDS}, nm as (select *, trim(manufacturer) = '' or manufacturer like 'Unknown%' as no_maker, trim(model) = '' or model like 'Unknown%' as no_model from fixtures),
    queue as (select doc_id, case when doc_id % 3 = 0 then 'channels.mains' else 'channels.none' end as prompt, '' as subject from fixtures where doc_id not in (select doc_id from channels)
    union all select doc_id, 'identity.manufacturer', '' from nm where no_maker union all select doc_id, 'identity.model', '' from nm where no_model union all select doc_id, 'identity.confidence', '' from nm where not no_maker and not no_model and confidence < 0.5
    union all select doc_id, 'mode.incomplete', name || ' ' || parsed || '/' || size from (select *, row_number() over (partition by doc_id order by mode_idx) as k from sizes where parsed < size and doc_id % 4 > 0) where k <= 6
    union all select doc_id, 'channel.confidence', cast(channel_idx + 1 as varchar) from (select *, row_number() over (partition by doc_id order by channel_idx) as k from channels where confidence < 0.6 and doc_id not in (select doc_id from sizes where doc_id % 4 > 0)) where k <= 3
    union all select distinct doc_id, 'wheel.color', '' from wk where kind = 'color' and confidence < 0.6 union all select distinct doc_id, 'wheel.gobo', '' from wk where kind = 'gobo' union all select distinct doc_id, 'channel.reset', '' from channels where kind = 'maintenance')"""


def queue(t: Tables) -> DataFrame:
    wheels = t("base").where("r <= 2").select("doc_id", F.when(F.col("sk") % 2 == 0, "color").otherwise("gobo").alias("kind"), ((F.col("pk") % 10) / 10.0).alias("confidence"))
    texts = t("fixtures").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "for a Triac Dimmer only").otherwise("a lamp").alias("text"))
    return validate.review_queue(t("fixtures"), t("channels"), parsed_sizes(t).where("doc_id % 4 > 0"), wheels, texts)


def name_edits(t: Tables) -> DataFrame:
    return t("log").select("doc_id", F.when(F.col("k") % 3 == 0, " ").otherwise(F.concat(F.lit(" Maker "), F.col("k").cast("string"))).alias("manufacturer"), F.when(F.col("level") % 2 == 0, "").otherwise(F.concat(F.lit("Model "), F.col("level").cast("string"))).alias("model"), "ts", "event_id")


NAMES = "edits as (select doc_id, case when k % 3 > 0 then 'Maker ' || k end as m, case when level % 2 > 0 then 'Model ' || level end as d, ts, event_id from log), last_names as (select doc_id, arg_max(m, struct_pack(a := ts, b := event_id)) filter (where m is not null) as m, arg_max(d, struct_pack(a := ts, b := event_id)) filter (where d is not null) as d from edits group by 1), renamed as (select f.doc_id, coalesce(m, manufacturer) as manufacturer, coalesce(d, model) as model from fixtures f left join last_names using (doc_id))"
case("v20_review_queue", queue, "fixtures channels assignments base", f"{QUEUE} select * from queue")
case("v21_apply_name_edits", lambda t: validate.apply_name_edits(t("fixtures"), name_edits(t)).select("doc_id", "manufacturer", "model"), "fixtures log", f"{NAMES} select doc_id, manufacturer, model from renamed")
case("v21_open_prompts", lambda t: validate.open_prompts(queue(t), t("log").select("doc_id", (F.col("k") % 4).alias("channel_idx")), validate.apply_name_edits(t("fixtures"), name_edits(t))), "fixtures channels assignments base log", f"""{QUEUE}, {NAMES} select doc_id, prompt, subject from queue q where not (prompt = 'channel.confidence' and exists (select 1 from log where log.doc_id = q.doc_id and starts_with(subject, cast(k % 4 + 1 as varchar))))
    and not (prompt = 'identity.manufacturer' and exists (select 1 from renamed r where r.doc_id = q.doc_id and trim(manufacturer) <> '' and manufacturer not like 'Unknown%')) and not (prompt = 'identity.model' and exists (select 1 from renamed r where r.doc_id = q.doc_id and trim(model) <> '' and model not like 'Unknown%'))""")  # fmt: skip
case("v21_apply_edits", lambda t: validate.apply_edits(t("channels"), t("log").select("doc_id", (F.col("k") % 4).alias("channel_idx"), F.when(F.col("level") % 3 == 0, " ").otherwise(F.col("event_type")).alias("name"), F.lit("").alias("kind"), "ts", "event_id")), "channels log", """e as (select doc_id, k % 4 as channel_idx, arg_max(case when level % 3 = 0 then ' ' else event_type end, struct_pack(a := ts, b := event_id)) as name from log group by 1, 2)
    select c.doc_id, c.channel_idx, coalesce(nullif(trim(e.name), ''), c.name) as name, c.kind, case when e.name is not null then 1.0 else c.confidence end as confidence from channels c left join e on e.doc_id = c.doc_id and e.channel_idx = c.channel_idx""")  # fmt: skip

# ---- evaluation


def truth(t: Tables) -> DataFrame:
    t.kept("base")  # its four readers find it dealt out by document
    return evaluate.truth_slots(t("truth_modes"), t("truth_channels"), t("truth_functions"))


def extracted(t: Tables) -> DataFrame:
    t.kept("base")
    return evaluate.extract_slots(t("extract_slots_raw"))


EVAL = "truth_modes truth_channels truth_functions extract_slots_raw truth_fixtures"
SLOTS = """tc as (select fixture_id as doc_id, idx as mode_idx, channel_id, coalesce(dmx_break, 1) as dmx_break, coalesce(pretty, attribute) as name, attribute, coalesce(n, 0) as n_functions, offset_coarse, offset_fine from truth_channels join truth_modes using (mode_id) left join (select channel_id, count(*) as n from truth_functions group by 1) f using (channel_id)),
    ts0 as (select doc_id, mode_idx, channel_id, dmx_break, offset_coarse as slot, name, attribute, n_functions, 0 as fine from tc where offset_coarse is not null union all select doc_id, mode_idx, channel_id, dmx_break, offset_fine, name, attribute, 0, 1 from tc where offset_fine is not null and offset_fine is distinct from offset_coarse),
    ts as (select doc_id, mode_idx, dmx_break, slot, name, attribute, n_functions, fine from (select *, row_number() over (partition by doc_id, mode_idx, dmx_break, slot order by channel_id desc, fine desc) as k from ts0) where k = 1),
    es as (select doc_id, mode_idx, dmx_break, channel_offset as slot, name, attribute, fine_of, n_ranges from (select *, row_number() over (partition by doc_id, mode_idx, dmx_break, channel_offset order by slot_idx desc) as k from extract_slots_raw where channel_offset is not null) where k = 1),
    tf as (select doc_id, mode_idx, count(*) as footprint from ts group by 1, 2), ef as (select doc_id, mode_idx, count(*) as footprint from es group by 1, 2),
    rp as (select doc_id, cast(sum(t) as bigint) as n_truth, cast(sum(e) as bigint) as n_extracted, sum(least(t, e)) / nullif(sum(t), 0) as recall, sum(least(t, e)) / nullif(sum(e), 0) as "precision" from (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(t, 0) as t, coalesce(e, 0) as e from (select doc_id, footprint, count(*) as t from tf group by 1, 2) a full join (select doc_id, footprint, count(*) as e from ef group by 1, 2) b on a.doc_id = b.doc_id and a.footprint = b.footprint) group by 1)"""


def prints(t: Tables) -> tuple[DataFrame, DataFrame]:
    return evaluate.footprints(truth(t)), evaluate.footprints(extracted(t))


case("e1_truth_slots", truth, EVAL, f"{SLOTS} select * from ts")
case("e2_extract_slots", extracted, EVAL, f"{SLOTS} select * from es")
case("e3_footprints", lambda t: prints(t)[0], EVAL, f"{SLOTS} select * from tf")
FILES = f"{MANIFEST}, mx as (select line_no, trim(split_part(value, '|', 1)) as file, trim(split_part(value, '|', 3)) as last from manifest_lines where value like '%|%'), my as (select line_no, file, try_cast(regexp_extract(last, '^([0-9]+)', 1) as bigint) as num, last from mx where lower(file) <> 'file'), man as (select file, case when last like '%int id%' then num end as fixture_id, case when last not like '%int id%' then upper(last) end as guid from (select *, row_number() over (partition by file order by line_no desc) as k from my) where k = 1), ex as (select 'm' || o_orderkey || '.txt' as file from orders), fx as (select o_orderkey as fixture_id, case when o_orderkey % 3 = 0 then 'ABCD-EF' || lpad(cast(o_orderkey as varchar), 6, '0') else 'x' end as gdtf_guid from orders where o_orderkey % 5 > 0), jt as (select file, fx.fixture_id from ex join man using (file) join fx on fx.fixture_id = man.fixture_id union all select file, fx.fixture_id from ex join man using (file) join fx on fx.gdtf_guid = man.guid where man.fixture_id is null)"


def files(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    ex = t("orders").select(F.concat(F.lit("m"), o.cast("string"), F.lit(".txt")).alias("file"))
    fx = t("orders").where("o_orderkey % 5 > 0").select(o.alias("fixture_id"), F.when(o % 3 == 0, F.concat(F.lit("ABCD-EF"), F.lpad(o.cast("string"), 6, "0"))).otherwise("x").alias("gdtf_guid"))
    return ex, records.parse_manifest(manifest_lines(t)), fx


case("e4_join_truth", lambda t: evaluate.join_truth(*files(t)), "", f"{FILES} select * from jt")
case("e5_unscored", lambda t: evaluate.unscored(files(t)[0], files(t)[1], evaluate.join_truth(*files(t))), "", f"{FILES} select file, 'no manifest row' as reason from ex where file not in (select file from man) union all select file, 'no truth' from ex where file in (select file from man) and file not in (select file from jt)")
case("e6_recall_precision", lambda t: evaluate.footprint_recall_precision(*prints(t)), EVAL, f"{SLOTS} select * from rp")
TOL1 = f"""recursive {SLOTS}, tl as (select doc_id, list(footprint order by footprint) as t from tf group by 1), el as (select doc_id, list(footprint order by footprint) as e from ef group by 1),
    step as (select tl.doc_id, t, 0 as i, 0 as n, coalesce(e, []) as pool from tl left join el on el.doc_id = tl.doc_id union all
      select doc_id, t, i + 1, n + (k is not null)::int, case when k is null then pool else list_concat(pool[:k - 1], pool[k + 1:]) end
      from (select *, list_position(list_transform(pool, lambda p: abs(p - t[i + 1]) <= 1), true) as k from step where i < len(t))),
    tol as (select doc_id, n / len(t) as recall_tol1 from step where i = len(t))"""
case("e7_recall_tol1", lambda t: evaluate.recall_tol1(*prints(t)), EVAL, f"{TOL1} select doc_id, recall_tol1 from tol")
case("e8_norm_name", lambda t: t("truth_channels").select("channel_id", tx.norm_name(F.col("pretty")).alias("norm")), "truth_channels", "select channel_id, regexp_replace(lower(coalesce(pretty, '')), '[^a-z0-9]', '', 'g') as norm from truth_channels")
# Ratcliff/Obershelp: the longest common run (first in a, then in b), then the same left and right of it
NORM = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"
RUN = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: flatten(list_transform(range(1, length(b) + 1), lambda j: list_transform(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda k: substr(a, i, k) = substr(b, j, k)), lambda k: {'k': k, 'i': -i, 'j': -j}))))))"""
RATIO = f"""rtree as (select a as a0, b as b0, a, b, cast(0 as bigint) as k from rpairs union all
      select a0, b0, p.a, p.b, p.k from (select a0, b0, unnest([{{'a': substr(a, 1, -m.i - 1), 'b': substr(b, 1, -m.j - 1), 'k': m.k}}, {{'a': substr(a, -m.i + m.k), 'b': substr(b, -m.j + m.k), 'k': cast(0 as bigint)}}]) as p
        from (select a0, b0, a, b, {RUN} as m from rtree where a <> '' and b <> '') x where m is not null) y),
    ratios as (select a0 as a, b0 as b, case when a0 <> '' or b0 <> '' then 2.0 * sum(k) / (length(a0) + length(b0)) end as ratio from rtree group by 1, 2)"""
case("e9_name_ratio", lambda t: evaluate.name_ratio(t("truth_channels").select(F.col("pretty").alias("a"), F.col("attribute").alias("b")).distinct()), "truth_channels", f"""recursive names as (select distinct pretty, attribute, {NORM.format('pretty')} as a, {NORM.format('attribute')} as b from truth_channels),
    rpairs as (select distinct a, b from names), {RATIO} select pretty as a, attribute as b, ratio as name_ratio from names join ratios using (a, b)""")
case("e10_pair_modes", lambda t: evaluate.pair_modes(*prints(t)), EVAL, f"{SLOTS} select t.doc_id, t.footprint, t.mode_idx as truth_mode, e.mode_idx as mode from tf t join ef e using (doc_id, footprint)")


def scored(t: Tables) -> DataFrame:
    return evaluate.score_pairs(truth(t), extracted(t))


def board(t: Tables) -> DataFrame:
    return evaluate.scoreboard(t("truth_fixtures"), t("extract_fixtures"), truth(t), extracted(t), t.written)


def small_board(t: Tables) -> DataFrame:
    fx = t("truth_fixtures").select(F.col("fixture_id").alias("doc_id"), "manufacturer")
    return fx.join(evaluate.footprint_recall_precision(*prints(t)).where("n_truth > 0"), "doc_id")


BOARD = f"{SLOTS}, bd as (select f.manufacturer, rp.* from truth_fixtures f join rp on rp.doc_id = f.fixture_id where n_truth > 0)"
# buckets of the bound data have two modes a side at most: the pairs of equal or of unlike rank are a pairing
SCORED = f"""recursive {SLOTS}, pj as (select t.doc_id, t.footprint, t.mode_idx as truth_mode, e.mode_idx as mode from tf t join ef e using (doc_id, footprint)),
    sj as (select pj.*, t.fine, t.n_functions, {NORM.format('t.name')} as a, {NORM.format('e.name')} as b, trim(coalesce(t.attribute, '')) as ta, trim(coalesce(e.attribute, '')) as ea, coalesce(e.fine_of, '') as fine_of, coalesce(e.n_ranges, 0) as n_ranges
      from pj join ts t on t.doc_id = pj.doc_id and t.mode_idx = truth_mode left join es e on e.doc_id = pj.doc_id and e.mode_idx = mode and e.dmx_break = t.dmx_break and e.slot = t.slot),
    rpairs as (select distinct a, b from sj where a <> '' union select distinct {NORM.format('f.manufacturer')}, {NORM.format('x.manufacturer')} from truth_fixtures f join extract_fixtures x using (fixture_id) union select distinct {NORM.format('f.model')}, {NORM.format('x.model')} from truth_fixtures f join extract_fixtures x using (fixture_id)), {RATIO},
    sc as (select doc_id, footprint, truth_mode, mode, coalesce(avg(ratio) filter (where fine = 0 and sj.a <> ''), 0.0) as name_score, coalesce(sum(ratio) filter (where fine = 0 and sj.a <> ''), 0.0) as name_sum, count(*) filter (where fine = 0 and sj.a <> '') as name_n,
      count(*) filter (where fine = 1 and fine_of <> '') as fine_hits, count(*) filter (where fine = 1) as fine_n, count(*) filter (where fine = 0 and sj.a <> '' and ta <> '' and lower(ta) = lower(ea)) as attr_hits, count(*) filter (where fine = 0 and sj.a <> '' and ta <> '') as attr_n,
      count(*) filter (where fine = 0 and n_functions > 1 and n_ranges > 1) as rich_hits, count(*) filter (where fine = 0 and n_functions > 1) as rich_n from sj left join ratios r on r.a = sj.a and r.b = sj.b group by 1, 2, 3, 4),
    sr as (select *, (dense_rank() over (partition by doc_id, footprint order by truth_mode) + dense_rank() over (partition by doc_id, footprint order by mode)) % 2 as way from sc),
    sw as (select doc_id, footprint, way, row_number() over (partition by doc_id, footprint order by round(sum(name_score), 9) desc, way) as k from sr group by 1, 2, 3),
    bp as (select sc.* from sc join sr using (doc_id, footprint, truth_mode, mode) join sw using (doc_id, footprint, way) where k = 1)"""
SCORING = f"{EVAL} extract_fixtures"
case("e11_score_pairs", lambda t: scored(t).withColumns({c: F.round(c, 9) for c in ("name_score", "name_sum")}), SCORING, f"{SCORED} select * replace (round(name_score, 9) as name_score, round(name_sum, 9) as name_sum) from sc")
case("e12_best_pairing", lambda t: evaluate.best_pairing(scored(t), t.written).withColumns({c: F.round(c, 9) for c in ("name_score", "name_sum")}), SCORING, f"{SCORED} select * replace (round(name_score, 9) as name_score, round(name_sum, 9) as name_sum) from bp")
case("e13_range_richness", lambda t: evaluate.best_pairing(scored(t), t.written).groupBy("doc_id").agg(F.try_divide(F.sum("rich_hits"), F.sum("rich_n")).alias("range_richness")), SCORING, f"{SCORED} select doc_id, sum(rich_hits) / nullif(sum(rich_n), 0) as range_richness from bp group by 1")
FLOATS = ("manufacturer_score", "model_score", "footprint_recall", "footprint_precision", "footprint_recall_tol1", "channel_name_score", "fine_byte_score", "strict_attribute_score", "range_richness")
LISTS = "string_agg(footprint, ';' order by footprint)"
FULL = f"""{SCORED}, {TOL1.removeprefix(f"recursive {SLOTS}, ")}, bs as (select doc_id, sum(name_sum) as ns, sum(name_n) as nn, sum(fine_hits) as fh, sum(fine_n) as fn, sum(attr_hits) as ah, sum(attr_n) as an, sum(rich_hits) as rh, sum(rich_n) as rn, count(*) as np from bp group by 1),
    tfl as (select doc_id, {LISTS} as l from tf group by 1), efl as (select doc_id, {LISTS} as l from ef group by 1),
    full_board as (select file, f.manufacturer as brand, f.model, x.manufacturer as extracted_manufacturer, x.model as extracted_model, r1.ratio as manufacturer_score, r2.ratio as model_score, rp.recall as footprint_recall, rp."precision" as footprint_precision, recall_tol1 as footprint_recall_tol1,
      ns / nullif(nn, 0) as channel_name_score, fh / nullif(fn, 0) as fine_byte_score, ah / nullif(an, 0) as strict_attribute_score, rh / nullif(rn, 0) as range_richness, cast(coalesce(rn, 0) as bigint) as range_richness_n, coalesce(np, 0) as n_mode_pairs,
      coalesce(n_truth, 0) as n_truth_modes, coalesce(n_extracted, 0) as n_extracted_modes, fixture_id, coalesce(tfl.l, '') as truth_footprints, coalesce(efl.l, '') as extract_footprints, coalesce(regexp_matches(trim(x.model), '(?i)\\bum$'), false) as filename_echo
      from truth_fixtures f join extract_fixtures x using (fixture_id) left join rp on rp.doc_id = fixture_id left join tol on tol.doc_id = fixture_id left join bs on bs.doc_id = fixture_id left join tfl on tfl.doc_id = fixture_id left join efl on efl.doc_id = fixture_id
      left join ratios r1 on r1.a = {NORM.format('f.manufacturer')} and r1.b = {NORM.format('x.manufacturer')} left join ratios r2 on r2.a = {NORM.format('f.model')} and r2.b = {NORM.format('x.model')})"""
case("e14_scoreboard", lambda t: board(t).withColumns({c: F.round(c, 9) for c in FLOATS}), SCORING, f"{FULL} select * replace ({', '.join(f'round({c}, 9) as {c}' for c in FLOATS)}) from full_board")
case("s14_scoreboard_rows", lambda t: records.scoreboard_rows(board(t)), SCORING, f"{FULL} select * replace ({', '.join(f'round({c}, 4) as {c}' for c in FLOATS)}) from full_board")
case("e15_metric_summary", lambda t: evaluate.metric_summary(small_board(t), ["recall", "precision"]), EVAL, f"""{BOARD} select 'recall' as metric, count(recall) as n, round(avg(recall), 6) as mean, round(median(recall), 6) as median, min(recall) as lowest, max(recall) as highest from bd union all select 'precision', count("precision"), round(avg("precision"), 6), round(median("precision"), 6), min("precision"), max("precision") from bd""")
case("e16_brand_rollup", lambda t: evaluate.brand_rollup(board(t)), SCORING, f"""{FULL} select brand, count(*) as n, round(avg(footprint_recall), 6) as mean_recall, round(avg(footprint_precision), 6) as mean_precision, round(avg(channel_name_score), 6) as mean_name_score from full_board group by 1""")
case("e17_health_counts", lambda t: evaluate.health_counts(board(t)), SCORING, f"{FULL} select count(*) filter (where footprint_recall = 0) as zero_recall, count(*) filter (where footprint_recall = 1) as perfect_recall, count(*) filter (where filename_echo) as filename_echo, count(*) as n from full_board")
case("e18_duplicate_audit", lambda t: evaluate.duplicate_audit(t("documents")), "", "select md5(text) as digest, count(*) as n, count(distinct source) as n_sources, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")

def rehosted(t: Tables) -> DataFrame:
    """Documents, and copies of one in five under other ids and another name."""
    d = t("documents").select("doc_id", "text", "source")
    return d.unionByName(d.where("doc_id % 5 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", F.lit("mirror").alias("source")))


def footprints_of(docs: DataFrame) -> DataFrame:
    prints = F.array(F.when(F.col("doc_id") % 3 != 1, 5), (F.col("doc_id") % 4 + 10).cast("int"), F.when(F.col("doc_id") % 10 < 6, 28))
    return docs.select("doc_id", F.explode(F.array_compact(prints)).alias("footprint"))


case("e18_conflicting_duplicates", lambda t: evaluate.conflicting_duplicates(rehosted(t), footprints_of(rehosted(t))), "", """d as (select doc_id, md5(text) as digest from documents union all select doc_id + 10000000, md5(text) from documents where doc_id % 5 = 0),
    g as (select digest, count(*) as n, min(doc_id) as first_doc from d where digest is not null group by 1 having count(*) > 1),
    p as (select digest, footprint, count(*) as k from (select distinct digest, doc_id, unnest([case when doc_id % 3 <> 1 then 5 end, doc_id % 4 + 10, case when doc_id % 10 < 6 then 28 end]) as footprint from d) where footprint is not null group by 1, 2)
    select g.digest, n, first_doc, count(p.k) as n_common from g left join p on p.digest = g.digest and p.k = g.n group by 1, 2, 3 having count(p.k) <= 1""")  # fmt: skip

# ---- lookup

NAME = "trim(regexp_replace(replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
TSCORE = "case when {a} = '' or {b} = '' then 0.0 when {a} = {b} then 1.0 when (length({b}) >= 4 and contains({a}, {b})) or (length({a}) >= 4 and contains({b}, {a})) then 0.88 else len(list_intersect(string_split({a}, ' '), string_split({b}, ' '))) / len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' ')))) end"
MATCH = f"""q as (select query_id, {NAME.format('manufacturer')} as qm, {NAME.format('model')} as qf, footprints as asked from queries), rr as (select rid, {NAME.format('manufacturer')} as rm, {NAME.format('fixture')} as rf, rating, footprints from listing),
    mk as (select * from (select qm, rm, {TSCORE.format(a='qm', b='rm')} as ms from (select distinct qm from q), (select distinct rm from rr)) where ms >= 0.55), md as (select * from (select qf, rf, {TSCORE.format(a='qf', b='rf')} as fs from (select distinct qf from q), (select distinct rf from rr)) where fs >= 0.55),
    mt as (select query_id, rid, score, rating from (select query_id, rid, 0.35 * ms + 0.6 * fs + 0.05 * case when asked = '' then 0.5 when len(list_intersect(string_split(asked, ' '), string_split(footprints, ' '))) > 0 then 1.0 else 0.0 end as score, rating from q join mk using (qm) join rr using (rm) join md using (qf, rf)) where score >= 0.72)"""


def matched(t: Tables) -> tuple[DataFrame, DataFrame]:
    listed = F.transform(F.filter(F.split("footprints", " "), lambda x: x != ""), lambda x: x.cast("int"))
    return t("queries").withColumn("footprints", listed), t("listing").withColumn("footprints", listed)


def matches(t: Tables) -> DataFrame:
    return lookup.match_listing(*matched(t))


case("f1_clean_text", lambda t: t("documents").select("doc_id", tx.clean_text(F.col("text"), 80).alias("text")), "", r"select doc_id, substr(trim(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g')), 1, 80) as text from documents")
case("f2_normalize_name", lambda t: t("makers").select("pk", tx.normalize_name(F.concat(F.col("maker"), F.lit(" & Sönß Ltd. É"))).alias("name")), "makers", f"select pk, {NAME.format('concat(maker, $$ & Sönß Ltd. É$$)')} as name from makers")
case("f3_text_score", lambda t: t("queries").join(t("listing"), F.col("query_id") == F.col("rid")).select("rid", tx.text_score(tx.normalize_name(F.col("model")), tx.normalize_name(F.col("fixture"))).alias("score")), "queries listing", f"x as (select rid, {NAME.format('model')} as a, {NAME.format('fixture')} as b from queries join listing on query_id = rid) select rid, {TSCORE.format(a='a', b='b')} as score from x")
case("f4_clean_footprints", lambda t: t("base").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("pk") * 100 - 5000)).alias("f")).select("doc_id", F.array_join(lookup.clean_footprints(F.col("f")), " ").alias("footprints")), "base", "select doc_id, coalesce(string_agg(f, ' ' order by f) filter (where f between 1 and 65535), '') as footprints from (select distinct doc_id, pk * 100 - 5000 as f from base) group by 1")


def variant_listing(t: Tables) -> DataFrame:
    text = F.concat(F.lit('[{"name": "a", "DmxFootprint": '), F.col("p_size").cast("string"), F.lit('}, {"nested": {"more": {"dmxfootprint": '), (F.col("p_partkey") % 30).cast("string"), F.lit("}}}]"))
    return t("part").select(F.col("p_partkey").alias("rid"), F.parse_json(text).alias("modes"))


case("f5_nested_footprints", lambda t: lookup.nested_footprints(variant_listing(t)), "", "select p_partkey as rid, p_size as footprint from part union all select p_partkey, cast(p_partkey % 30 as int) from part")
case("f6_match_listing", matches, "queries listing", f"{MATCH} select query_id, rid, score, rating from mt")
case("f7_top_matches", lambda t: lookup.best_matches(*matched(t)), "queries listing", f"{MATCH} select query_id, rid, score, rating, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, coalesce(rating, 0) desc, rid) as rank from mt) where rank <= 5")
def shown_matches(t: Tables) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 11 == 0, "").when(k % 11 == 1, F.regexp_replace("url", "^https?://", "https://user:pw@")).when(k % 11 == 2, F.concat("url", F.lit("#part"))).when(k % 11 == 3, "https://EXAMPLE.com").otherwise(F.regexp_replace("url", "^http://", "https://"))
    maker = F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("Maker\t"), k.cast("string")))
    return t("pages").select(k.alias("id"), maker.alias("manufacturer"), F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise("lamp").alias("fixture"), F.when(k % 2 == 0, "manufacturer").otherwise("forum").alias("source"), url.alias("url"), F.when(k % 5 == 0, "none").otherwise((k % 9 - 1.5).cast("string")).alias("rating"), (k % 7 / 4 - 0.25).alias("score"))


case("f8_sanitize_matches", lambda t: lookup.sanitize_matches(shown_matches(t), ["example.com", "example.org"], "https://example.org/"), "", r"""x as (select page_id, case page_id % 11 when 0 then 'https://example.org/' when 1 then regexp_replace(url, '^https?://', 'https://') when 2 then url when 3 then 'https://EXAMPLE.com/' else regexp_replace(url, '^http://', 'https://') end as u, page_id % 11 = 1 as user_, url from pages)
    select cast(page_id as varchar) as id, 'Maker ' || page_id as manufacturer, 'lamp' as fixture, case when page_id % 2 = 0 then 'manufacturer' else 'community' end as source, regexp_replace(case when regexp_matches(u, '(?i)^https://[^/?]+$') then u || '/' else u end, '#.*$', '') as url,
      case when page_id % 5 > 0 then cast(least(5.0, greatest(0.0, page_id % 9 - 1.5)) as double) end as rating, cast(least(1.0, greatest(0.0, page_id % 7 / 4 - 0.25)) as double) as score
    from x where page_id % 13 > 0 and page_id % 17 > 0 and regexp_matches(u, '(?i)^https://example\.(com|org)(/|$|\?)')""")  # fmt: skip
case("f9_lookup_eligible", lambda t: lookup.lookup_eligible(t("fixtures").withColumn("from_manual", F.col("doc_id") % 6 > 0), parsed_sizes(t).select("doc_id", F.col("size").alias("footprint"))), "fixtures assignments", f"{PARSED}, p as (select doc_id, string_agg(size, ' ' order by size) as f from (select distinct doc_id, size from sizes) group by 1) select doc_id, manufacturer, model, coalesce(f, '') as footprints from fixtures left join p using (doc_id) where doc_id % 6 > 0 and trim(manufacturer) <> '' and trim(model) <> '' and model <> 'Unknown model'")
HISTORY = "history as (select doc_id, ts, event_id, event_type as key, level % 17 = 0 as forced from log)"


def history(t: Tables) -> DataFrame:
    return t("log").select("doc_id", "ts", "event_id", F.col("event_type").alias("key"), (F.col("level") % 17 == 0).alias("forced"))


case("f10_changed_lookups", lambda t: lookup.changed_lookups(history(t)), "log", f"{HISTORY} select doc_id, ts, event_id, key, forced from (select *, lag(key) over (partition by doc_id order by ts, event_id) as p from history) where forced or key is distinct from p")
case("f10_newest_results", lambda t: lookup.newest_results(history(t)), "log", f"{HISTORY} select doc_id, arg_max(key, struct_pack(a := ts, b := event_id)) as key from history group by 1")

# ---- publishing

CAPS = """caps as (select r.doc_id, c.channel_idx, r.range_idx, case when kind in ('goboWheel', 'colorWheel') then 'Generic' else case kind when 'intensity' then 'Intensity' when 'colorIntensity' then 'ColorIntensity' when 'pan' then 'Pan' when 'tilt' then 'Tilt' when 'strobe' then 'ShutterStrobe' when 'speed' then 'EffectSpeed' when 'maintenance' then 'Maintenance' else 'Generic' end end as type,
    case when kind = 'colorIntensity' then case when color = '' then 'White' else upper(color[1]) || lower(color[2:]) end end as color, case when kind = 'strobe' then case when regexp_matches(lower(r.name), 'off|closed') then 'Closed' when regexp_matches(lower(r.name), 'on|open') then 'Open' else 'Strobe' end end as shutter_effect from ranges r join channels c on c.doc_id = r.doc_id and c.channel_id = r.channel_id)"""
GDTF = rf"""gx as (select *, regexp_matches(name, '(?i)\b(fine|lsb)\b') as f from mode_rows), gy as (select *, lead(f) over w as nf, lead(position) over w as np, lead(kind) over w as nk from gx window w as (partition by doc_id, mode_idx order by position)),
    gdtf as (select doc_id, mode_idx, position, case when coalesce(nf and nk = kind, false) then position || ',' || np else cast(position as varchar) end as "offset", {ATTR} as attribute, {FEAT} as feature from gy where not f)"""
case("x1_capability_rows", lambda t: publish.capability_rows(t("channels"), t("ranges")), "channels ranges", f"{CAPS} select * from caps")


def open_docs(t: Tables) -> DataFrame:
    n = F.explode(F.sequence(F.lit(1), F.col("pk") % 4 + 1))
    wheels = t("base").where("r = 1").select("doc_id", F.lit("w1").alias("wheel_id"), F.when(F.col("sk") % 2 == 0, "color").otherwise("gobo").alias("kind"), n.alias("number"), F.when(F.col("sk") % 3 == 0, "open").otherwise("slot").alias("name"), F.lit("#FF0000").alias("color"))
    return publish.open_format_docs(t("fixtures"), t("channels"), t("ranges"), t("modes"), t("assignments"), wheels)


def open_parts(t: Tables) -> DataFrame:
    """The records read back: a row for each channel, mode and wheel."""
    cap = "struct<type:string,comment:string,dmxRange:array<int>,color:string,shutterEffect:string>"
    doc = F.from_json("json", f"name string, meta struct<createDate:string>, availableChannels map<string,struct<capability:{cap},capabilities:array<{cap}>,fineChannelAliases:array<string>,dmxValueResolution:string>>, modes array<struct<name:string,channels:array<string>>>, wheels map<string,struct<slots:array<struct<type:string,name:string,colors:array<string>>>>>")
    d = open_docs(t).select("doc_id", doc.alias("d"))
    types = F.array_join(F.transform(F.coalesce("c.capabilities", F.array("c.capability")), lambda x: F.concat_ws(" ", x["type"], F.array_join(x["dmxRange"].cast("array<string>"), "-"), x["color"], x["shutterEffect"])), ",")
    ch = d.select("doc_id", F.explode("d.availableChannels").alias("key", "c")).select("doc_id", F.lit("channel").alias("part"), "key", F.concat_ws(";", types, F.array_join("c.fineChannelAliases", ","), "c.dmxValueResolution").alias("what"))
    md = d.select("doc_id", F.explode("d.modes").alias("m")).select("doc_id", F.lit("mode").alias("part"), F.col("m.name").alias("key"), F.array_join("m.channels", ",").alias("what"))
    wh = d.select("doc_id", F.explode("d.wheels").alias("key", "w")).select("doc_id", F.lit("wheel").alias("part"), "key", F.array_join(F.transform("w.slots", lambda x: F.concat_ws(" ", x["type"], x["name"], F.array_join(x["colors"], ","))), ";").alias("what"))
    top = d.select("doc_id", F.lit("record").alias("part"), F.col("d.name").alias("key"), F.col("d.meta.createDate").alias("what"))
    return top.unionByName(ch).unionByName(md).unionByName(wh)


case("x2_open_format_docs", open_docs)
case("x2_open_format_parts", open_parts, "base fixtures channels ranges modes assignments", f"""{CAPS}, cq as (select caps.*, c.channel_id, r.range_start, r.range_end from caps join channels c on c.doc_id = caps.doc_id and c.channel_idx = caps.channel_idx join ranges r on r.doc_id = c.doc_id and r.channel_id = c.channel_id and r.range_idx = caps.range_idx),
    cn as (select doc_id, channel_idx, count(*) as n from cq group by 1, 2),
    cs as (select doc_id, channel_idx, string_agg(concat_ws(' ', type, case when n > 1 then range_start || '-' || range_end else null end, color, shutter_effect), ',' order by range_idx) as whole, string_agg(concat_ws(' ', type, color, shutter_effect), ',' order by range_idx) as bare, any_value(n) as n from cq join cn using (doc_id, channel_idx) group by 1, 2),
    fi as (select doc_id, fine_of as channel_id, arg_min(channel_id, channel_idx) as fine from channels where fine_of is not null group by 1, 2),
    lastc as (select doc_id, channel_id, max(channel_idx) as channel_idx from channels where fine_of is null group by 1, 2)
    select doc_id, 'record' as part, model as key, cast(imported as varchar) as what from fixtures
    union all select l.doc_id, 'channel', l.channel_id, concat_ws(';', case when n > 1 then replace(whole, '  ', ' ') else bare end, fine, case when fine is not null then '16bit' end) from lastc l join fixtures using (doc_id) left join cs using (doc_id, channel_idx) left join fi on fi.doc_id = l.doc_id and fi.channel_id = l.channel_id
    union all select m.doc_id, 'mode', name, string_agg(channel_id, ',' order by slot_idx) from modes m join assignments a on a.doc_id = m.doc_id and a.mode_idx = m.mode_idx where dmx_break = 1 group by 1, 2, 3, m.mode_idx
    union all select doc_id, 'wheel', 'w1', string_agg(case when k = 1 and sk % 3 = 0 then 'Open' when sk % 2 = 0 then concat('Color ', case when sk % 3 = 0 then 'open' else 'slot' end, ' #FF0000') else concat('Gobo ', case when sk % 3 = 0 then 'open' else 'slot' end) end, ';' order by k) from (select doc_id, pk, sk, unnest(range(1, pk % 4 + 2)) as k from base where r = 1) where pk % 4 >= 1 group by 1""")  # fmt: skip
case("x3_gdtf_channels", lambda t: publish.gdtf_channels(t("mode_rows")), "mode_rows", f"{GDTF} select * from gdtf")
case("x3_gdtf_attributes", lambda t: publish.gdtf_attributes(t("mode_rows")), "mode_rows", f"{GDTF}, ga as (select doc_id, attribute, feature, min(mode_idx * 10000 + position) as first from gdtf group by 1, 2, 3) select doc_id, attribute, feature, row_number() over (partition by doc_id order by first, attribute) as ord from ga")
case("x3_gdtf_feature_groups", lambda t: publish.gdtf_feature_groups(t("channels").withColumn("gdtf_feature", F.when(F.col("kind") == "laser", "Beam.Beam").when(F.col("kind") == "generic", "Gobo").otherwise(""))), "channels", f"""f as (select doc_id, channel_idx, case when kind = 'laser' then 'Beam' when kind = 'generic' then 'Gobo' else {FEAT} end as feature_group, case when kind = 'laser' then 'Beam' else 'Control' end as feature from channels where fine_of is null)
    select doc_id, feature_group, feature, cast(row_number() over (partition by doc_id order by first_at, feature_group, feature) as int) as ord from (select doc_id, feature_group, feature, min(channel_idx) as first_at from f group by 1, 2, 3)""")  # fmt: skip
WHEELS = "ws as (select distinct doc_id, concat('ch', cast(ln as varchar)) as channel_id, unnest(range(1, pk % 3 + 2)) as slot from base where pk % 16 in (10, 11))"


def slots_of_wheels(t: Tables) -> DataFrame:
    w = t("base").where("pk % 16 in (10, 11)")
    return w.select("doc_id", F.concat(F.lit("ch"), F.col("ln").cast("string")).alias("channel_id"), F.explode(F.sequence(F.lit(1), F.col("pk") % 3 + 1)).alias("slot")).distinct()


case("x3_gdtf_wheel_slots", lambda t: publish.gdtf_wheel_slots(slots_of_wheels(t).select("doc_id", F.col("channel_id").alias("wheel_id"), (F.col("slot") * 5).alias("number"), F.concat(F.lit("Slot "), F.col("slot").cast("string")).alias("name"))), "base", f"{WHEELS} select doc_id, channel_id as wheel_id, cast(row_number() over (partition by doc_id, channel_id order by slot) as int) as slot, 'Slot ' || slot as name from ws")
case("x3_gdtf_functions", lambda t: publish.gdtf_functions(t("mode_rows"), t("channels"), t("ranges"), slots_of_wheels(t)), "base mode_rows channels ranges", f"""{GDTF}, {WHEELS}, x as (select *, row_number() over (partition by doc_id, channel_id order by range_start, range_idx) - 1 as source, {REACH} + 1 as nxt from ranges where range_start <= range_end and range_start <= 255),
    tops as (select doc_id, channel_id, max(range_end) as top from x group by 1, 2),
    done as (select doc_id, channel_id, greatest(range_start, nxt) as a, least(range_end, 255) as b, name, source from x where range_end >= nxt
      union all select doc_id, channel_id, nxt, range_start - 1, 'Unspecified', null from x where range_start > nxt union all select doc_id, channel_id, top + 1, 255, 'Unspecified', null from tops where top < 255
      union all select distinct doc_id, channel_id, 0, 255, 'Full range', null from channels c where not exists (select 1 from tops where tops.doc_id = c.doc_id and tops.channel_id = c.channel_id)),
    n as (select doc_id, channel_id, max(slot) as slots from ws group by 1, 2)
    select g.doc_id, g.mode_idx, g.position, m.channel_id, cast(row_number() over (partition by g.doc_id, g.mode_idx, g.position, m.channel_id order by a) as int) as fn, d.name, g.attribute, case when "offset" like '%,%' then a * 257 else a end as dmx_from,
      case when "offset" like '%,%' then case when b = 255 then 65535 else (b + 1) * 257 - 1 end else b end as dmx_to, cast(case when source < slots then source + 1 end as int) as wheel_slot
    from gdtf g join mode_rows m on m.doc_id = g.doc_id and m.mode_idx = g.mode_idx and m.position = g.position join done d on d.doc_id = g.doc_id and d.channel_id = m.channel_id left join n on n.doc_id = g.doc_id and n.channel_id = m.channel_id""")  # fmt: skip
case("x4_stable_uuid", lambda t: t("fixtures").select("doc_id", tx.stable_uuid(F.concat_ws("/", "manufacturer", "model")).alias("uuid")), "fixtures", r"""h as (select doc_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('/', manufacturer, model))) as h from fixtures)
    select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast(cast(concat('0x', substr(h, 17, 1)) as integer) % 4 + 1 as bigint), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid from h""")  # fmt: skip
