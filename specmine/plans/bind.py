"""Inputs derived from the given tables, by one SQL text for Spark and for the oracle.

The prose of ``documents`` holds no channel tables, so manuals, records, layouts and logs are
plain projections of the star schema. Rows of an order are put in order by line number, part,
supplier and price; everything else is arithmetic on the keys. ``{table}`` stands for a table.
"""

from __future__ import annotations

import re
from collections.abc import Container, Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL: dict[str, str] = {
    "base": """
        select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as r,
          cast(count(*) over (partition by l_orderkey) as int) as n, cast(l_linenumber as int) as ln, cast(l_partkey as int) as pk, cast(l_suppkey as int) as sk,
          cast(floor(l_quantity) as int) as qty, cast(round(l_discount * 1000) as int) as conf
        from {lineitem}""",
    # ---- B1: lines of manuals
    "lines": """
        select doc_id, cast(floor((line_no - 1) / 4) as int) + 1 as page, line_no, text from (
          select doc_id, cast(row_number() over (partition by doc_id order by pos) as int) as line_no, text from (
            select doc_id, 10 * r as pos, concat(
              case when pk % 5 = 0 then '' else concat(cast(ln as string), '   ') end,
              case when doc_id % 8 in (1, 2, 3) and pk % 5 > 0 then case when pk % 3 = 0 then '-   ' else concat(cast(ln + 1 as string), '   ') end else '' end,
              cast((qty * 5) % 200 as string), '-', cast((qty * 5) % 200 + pk % 56 as string), '   ',
              case when pk % 13 = 0 then 'Strobe speed' when pk % 13 = 1 then 'no function' when pk % 13 = 2 then 'Page 3' else p_name end) as text
            from base join {part} on p_partkey = pk
            union all
            select doc_id, 1 as pos, case doc_id % 8 when 0 then 'DMX mode chart' when 1 then concat('Operating modes: ', cast(n as string), ' channels and ', cast(n + 3 as string), ' channels')
              when 2 then '3 channel mode, 12 channel mode' when 3 then 'Mode and channel overview' when 4 then concat('Choose from ', cast(n as string), ' ch or ', cast(2 * n as string), ' ch')
              when 5 then 'Personality list' when 6 then 'Wash DMX Mode' else concat('Basic ', cast(n as string), ' ch') end as text from base where r = 1
            union all
            select doc_id, 2 as pos, case doc_id % 8 when 0 then 'DMX channel table' when 1 then concat(cast(n as string), 'Ch ', cast(n + 3 as string), 'Ch Function')
              when 2 then '3 12 Function' when 3 then concat('Mode total ', cast(n as string), ' ', cast(n + 2 as string), ' Value') when 4 then concat(cast(n as string), '-channel mode')
              when 5 then concat('TABLE ', cast(n as string), 'CA DMX values') when 6 then concat(cast(n as string), ' DMX channels') else concat('Extended ', cast(n + 4 as string), ' ch') end as text from base where r = 1
            union all
            select doc_id, 10 * r + 5 as pos, case doc_id % 8 when 4 then concat(cast(2 * n as string), '-channel mode') when 6 then 'Spot DMX Mode' when 5 then concat('Table ', cast(n as string), 'CB DMX values')
              when 1 then concat(cast(n as string), 'Ch ', cast(n + 3 as string), 'Ch Function') when 0 then 'DMX channel table' when 3 then '...' else 'User manual' end as text from base where r = 3
            union all
            select doc_id, 10 * r + 6 as pos, concat(cast(n + 1 as string), ' DMX channels') as text from base where r = 3 and doc_id % 8 = 6) x) y""",
    # modes named one after another, most of which name the mode whose first channels they share
    "named_lines": """
        select doc_id, cast(row_number() over (partition by doc_id order by pos) as int) as line_no, text from (
          select doc_id, 10 * r as pos, concat(case when pk % 3 = 0 then 'LEVEL/' else 'Level ' end, cast(r as string), ' DMX Mode') as text from base
          union all select doc_id, 10 * r + 1, concat(cast(pk % 6 + 4 as string), ' DMX channels') from base
          union all select doc_id, 10 * r + 2, concat('Channels 1 - ', cast(pk % 5 + 1 as string), ' as in ', case when pk % 2 = 0 then 'level-' else 'Level ' end, cast(case when pk % 7 = 0 then r + 1 when pk % 4 = 0 and r > 2 then r - 2 else r - 1 end as string), ' Mode') from base where r > 1
          union all select doc_id, 10 * r + 3, concat(cast(case when r = 1 then 1 else pk % 5 + 2 end as string), '   0-255   part ', cast(pk as string)) from base
          union all select doc_id, 10 * r + 4, concat(cast(case when r = 1 then 2 else pk % 5 + 1 + sk % 3 end as string), '   0-99   second ', cast(pk as string)) from base
          union all select doc_id, 10 * r + 5, 'FX list' from base where pk % 9 = 0
          union all select doc_id, 10 * r + 6, concat(cast(pk % 5 + 3 as string), '   0-9   listed') from base where pk % 9 = 0) x""",
    # personalities in parallel columns, whose names stand in another order than they are listed in
    "personality_lines": """
        select doc_id, cast(row_number() over (partition by doc_id order by pos) as int) as line_no, text from (
          select doc_id, 1 as pos, 'Single Control Mode' as text from base where r = 1
          union all select doc_id, 2, concat('Alpha (', cast(n + 2 as string), 'CH) / Beta (', cast(n + 4 as string), 'CH)') from base where r = 1
          union all select doc_id, 3, case pk % 5 when 0 then 'Alpha      Beta' when 1 then concat(repeat(' ', pk % 7), 'Beta        ALPHA') when 2 then '   Alpha' when 3 then 'Alpha' else '      Function' end from base where r = 1
          union all select doc_id, 4, case pk % 5 when 3 then 'Beta' when 4 then 'beta alpha' else 'no names' end from base where r = 1
          union all select doc_id, 10 + r, concat(cast(ln as string), '   ', case when pk % 3 = 0 then '-' else cast(r as string) end, '   ', cast((qty * 5) % 200 as string), '-', cast((qty * 5) % 200 + pk % 56 as string), '   value ', cast(pk as string)) from base
          union all select doc_id, 40, 'Dual Control Mode - Pixels' from base where r = 1 and pk % 6 > 0
          union all select doc_id, 41, concat('Gamma ray (', cast(n as string), 'CH)') from base where r = 1
          union all select doc_id, 50 + r, concat(cast(r as string), '   0-', cast(pk % 256 as string), '   pixel ', cast(ln as string)) from base) x""",
    # headers of matrix tables, with a legend or label near, far or missing above them
    "matrix_lines": """
        select doc_id, 1 as page, cast(row_number() over (partition by doc_id order by pos) as int) as line_no, text from (
          select doc_id, 1 as pos, case doc_id % 4 when 0 then '5: Basic mode' when 1 then 'Legend 7 :' when 2 then 'no legend' else '3:Tilt' end as text from base where r = 1
          union all select doc_id, 2, repeat('filler text ', pk % 45) from base where r = 1
          union all select doc_id, 3, case when pk % 5 = 0 then '3   3   Function' when pk % 5 = 1 then '4 8 12 FUNCTION name' when pk % 5 = 2 then '3   Function' else '  3   12   Function' end from base where r = 1
          union all select doc_id, 10 + r, concat(cast(ln as string), '   ', cast(r as string), '   0-', cast(pk % 256 as string), '   part') from base
          union all select doc_id, 30, case pk % 4 when 0 then 'Mode/Total channels' when 1 then 'DMX mode / channel list' when 2 then 'Mode overview' else 'Mode/' end from base where r = 1
          union all select doc_id, 31, case when pk % 4 = 3 then 'Total channel' else repeat('more text ', sk % 60) end from base where r = 1
          union all select doc_id, 32, case pk % 3 when 0 then '1/5   2/28   Value   control' when 1 then '1   2   Value' else '3   Value 1' end from base where r = 1) x""",
    # value tables in an appendix, with and without an end
    "appendix_lines": """
        select doc_id, cast(row_number() over (partition by doc_id order by pos) as int) as line_no, text from (
          select doc_id, 1 as pos, 'Shutter' as text from base where r = 1
          union all select doc_id, 10 + r, concat(case when pk % 4 = 0 then '7   ' else '' end, cast((qty * 5) % 200 as string), case when pk % 2 = 0 then '-' else ' – ' end, cast((qty * 5) % 200 + pk % 90 as string), '   ', case pk % 5 when 0 then 'Strobe fast ...' when 1 then 'Strobe off' when 2 then 'Page 7' else 'Open' end) from base
          union all select doc_id, 40, case when sk % 2 = 0 then 'Mode table 2' else 'MODE  TABLE ②' end from base where r = 1 and pk % 3 > 0
          union all select doc_id, 41, 'Virtual colour wheel*' from base where r = 1
          union all select doc_id, 50 + r, concat(cast(r * 10 as string), '-', cast(r * 10 + 9 as string), '   Colour ', cast(pk as string)) from base
          union all select doc_id, 90, case when pk % 2 = 0 then '12   Zoom' else 'Other' end from base where r = 1) x""",
    # ---- B2: structured records
    "channels": """
        select doc_id, r - 1 as channel_idx, concat('ch', cast(ln as string)) as channel_id,
          case pk % 16 when 0 then 'Pan' when 1 then 'Pan fine' when 2 then 'Tilt' when 3 then 'Tilt LSB' when 4 then 'Dimmer' when 5 then 'Dimmer fine' when 6 then 'Red' when 7 then 'Red fine'
            when 8 then concat('Green ', cast(sk % 4 as string)) when 9 then 'Strobe' when 10 then 'Gobo wheel' when 11 then 'Color wheel' when 12 then 'Reset' when 13 then 'Program speed' when 14 then 'small ring 7' else '255' end as name,
          case pk % 16 when 0 then 'pan' when 1 then 'pan' when 2 then 'tilt' when 3 then 'tilt' when 4 then 'intensity' when 5 then 'intensity' when 6 then 'colorIntensity' when 7 then 'colorIntensity'
            when 8 then 'colorIntensity' when 9 then 'strobe' when 10 then 'goboWheel' when 11 then 'colorWheel' when 12 then 'maintenance' when 13 then 'speed' when 14 then 'generic' else 'laser' end as kind,
          case when pk % 16 in (6, 7) then 'RED' when pk % 16 = 8 then 'GREEN' else '' end as color,
          case when pk % 16 in (1, 3, 5, 7) then concat('ch', cast(ln - 1 as string)) end as fine_of,
          case when pk % 16 = 14 then 'Gobo1Pos' when pk % 16 = 0 then 'Pan' else '' end as gdtf_attribute,
          cast((pk % 10) / 10.0 as double) as confidence
        from base""",
    "ranges": """
        select doc_id, concat('ch', cast(ln as string)) as channel_id, cast(row_number() over (partition by doc_id, ln order by r, which) as int) - 1 as range_idx,
          range_start, range_end, name, safety, confidence
        from (
          select doc_id, r, ln, 0 as which, (qty * 5) % 200 as range_start, (qty * 5) % 200 + pk % 56 as range_end, case when pk % 7 = 0 then '' else concat('r', cast(pk % 5 as string)) end as name,
            case sk % 5 when 0 then 'strobe' when 1 then 'reset' else 'normal' end as safety, cast((sk % 10) / 10.0 as double) as confidence from base
          union all
          select doc_id, r, ln, 1 as which, (qty * 7 + 40) % 256 as range_start, least(255, (qty * 7 + 40) % 256 - 10 + pk % 90) as range_end, 'second' as name, 'normal' as safety, 0.9 as confidence from base) x""",
    "modes": """
        select distinct doc_id, sk % 2 as mode_idx, concat('m', cast(sk % 2 as string)) as mode_id, case when sk % 2 = 0 then 'Basic' else 'Extended' end as name, 1 as breaks from base""",
    "assignments": """
        select doc_id, sk % 2 as mode_idx, cast(row_number() over (partition by doc_id, sk % 2 order by r) as int) - 1 as slot_idx,
          case when pk % 17 = 0 then 'gone' else concat('ch', cast(ln as string)) end as channel_id,
          ln + case when pk % 11 = 0 then 512 else 0 end as channel_offset, 1 + case when pk % 23 = 0 then 1 else 0 end as dmx_break
        from base""",
    "fixtures": """
        select o_orderkey as doc_id, case when o_orderkey % 50 = 0 then ' ' else concat('Maker ', cast(o_custkey % 9 as string)) end as manufacturer,
          case when o_orderkey % 70 = 0 then '' when o_orderkey % 31 = 0 then 'Unknown model' else concat('Model ', cast(o_custkey as string)) end as model,
          o_orderpriority as category, cast((o_custkey % 10) / 10.0 as double) as confidence, cast(o_orderdate as date) as imported
        from {orders}""",
    # mode rows: a channel of a mode at a position, in order
    "mode_rows": """
        select a.doc_id, a.mode_idx, a.slot_idx + 1 as position, c.channel_idx, c.channel_id, c.name, c.kind, c.color, c.confidence
        from (select doc_id, sk % 2 as mode_idx, r, cast(row_number() over (partition by doc_id, sk % 2 order by r) as int) - 1 as slot_idx from base) a
        join channels c on c.doc_id = a.doc_id and c.channel_idx = a.r - 1""",
    # ---- B3: prose as manuals
    "manuals": """
        select doc_id, concat(text, case doc_id % 6 when 0 then ' Thank you for purchasing this Off lamp.' when 1 then ' All of this und product.' when 2 then ' Buying this les' when 3 then ' Model: X-3' else '' end) as text, lang, source, concat(source, '_', cast(doc_id as string), case when doc_id % 3 = 0 then '_User_Manual_rev2' when doc_id % 3 = 1 then ' MX' else ' Spot 300X manual' end, '.pdf') as source_name from {documents}""",
    # ---- B3c: makers and models
    "makers": """
        select case pk % 3 when 0 then p_brand when 1 then lower(p_brand) else concat(upper(p_brand), ' ') end as maker, model, pk from (
          select p_partkey as pk, p_brand, p_name as model from {part}) x""",
    "listing": """
        select p_partkey as rid, p_brand as manufacturer, case when p_partkey % 3 = 1 then replace(p_name, ' ', '') else p_name end as fixture, cast((p_partkey % 50) / 10.0 as double) as rating,
          concat(cast(p_size as string), ' ', cast(p_size + 3 as string)) as footprints from {part} where p_partkey % 5 = 0""",
    "queries": """
        select p_partkey as query_id, case when p_partkey % 2 = 0 then p_brand else upper(p_brand) end as manufacturer, case when p_partkey % 3 = 0 then concat(p_name, ' pro') when p_partkey % 3 = 1 then concat('x', replace(p_name, ' ', '')) else p_name end as model,
          case when p_partkey % 2 = 0 then '' else concat(cast(p_size + 3 as string), ' 7') end as footprints from {part} where p_partkey % 7 = 0""",
    # ---- B4: truth and extraction
    "truth_modes": """
        select distinct doc_id * 2 + sk % 2 as mode_id, doc_id as fixture_id, sk % 2 as idx, case when sk % 2 = 0 then 'Basic' else 'Extended' end as name from base""",
    "truth_fixtures": """
        select o_orderkey as fixture_id, case when o_orderkey % 4 = 3 then 'user' else 'library' end as source, upper(concat('guid-', cast(o_orderkey as string))) as gdtf_guid,
          concat('Maker ', cast(o_custkey % 9 as string)) as manufacturer, concat('Model ', cast(o_custkey as string)) as model from {orders}""",
    "truth_channels": """
        select cast(doc_id * 100 + r as bigint) as channel_id, doc_id * 2 + sk % 2 as mode_id, case when pk % 9 = 0 then cast(null as int) else 1 end as dmx_break, ln as offset_coarse,
          case when pk % 4 = 0 then ln + 1 end as offset_fine, case pk % 6 when 0 then 'Dimmer' when 1 then 'Pan' when 2 then concat('Gobo', cast(sk % 3 as string), 'Pos') when 3 then 'NoFeature' when 4 then 'Shutter1' else 'ColorAdd_R' end as attribute,
          case when pk % 10 = 0 then cast(null as string) else case pk % 6 when 0 then 'Dimmer fine' when 1 then concat('Pan ', cast(sk % 2 as string)) when 2 then concat('Gobo wheel ', cast(sk % 3 as string)) when 3 then 'Reserved' when 4 then 'Shutter' else 'Red' end end as pretty
        from base""",
    "truth_functions": """
        select cast(doc_id * 100 + r as bigint) as channel_id, f as fn from base cross join (select 1 as f union all select 2 union all select 3) y where f <= pk % 4""",
    "extract_slots_raw": """
        select doc_id, sk % 2 as mode_idx, cast(row_number() over (partition by doc_id, sk % 2 order by r) as int) - 1 as slot_idx, 1 as dmx_break, case when pk % 8 = 7 then cast(null as int) else ln end as channel_offset,
          case when pk % 4 = 1 then 'Dimmer' else case pk % 6 when 0 then 'Dimmer' when 1 then 'Pan' when 2 then 'Gobo wheel' else 'Red' end end as name, case when pk % 4 = 0 then 'Dimmer' else 'Pan' end as attribute, pk % 3 as n_ranges,
          case pk % 5 when 0 then concat('ch', cast(ln - 1 as string)) when 1 then '' end as fine_of
        from base where pk % 9 > 0""",
    "extract_fixtures": """
        select o_orderkey as fixture_id, concat('m', cast(o_orderkey as string), '.txt') as file, case when o_orderkey % 6 = 0 then '' else concat('Makers ', cast(o_custkey % 9 as string)) end as manufacturer,
          case o_orderkey % 7 when 0 then concat('m', cast(o_orderkey as string), ' UM') when 1 then cast(null as string) else concat('model-', cast(o_custkey as string)) end as model
        from {orders} where o_orderkey % 11 > 0""",
    # ---- B5: positioned items
    "items": """
        select doc_id, 1 as page, r as item_no, case when pk % 19 = 0 then ' ' when pk % 4 = 0 then cast(ln as string) when pk % 4 = 1 then 'A' else 'word' end as text,
          cast(ln * 45 + pk % 5 as double) as x, cast(800 - (pk % 7) * 12 + sk % 3 as double) as y, cast(8 + qty as double) as width, cast(8 + qty % 5 as double) as height, conf as confidence, sk % 4 as rotation
        from base""",
    # ---- B6: logs
    "log": """
        select user_id, event_id, ts, event_type, event_id % 3 > 0 as ok, cast({k} as int) as k, cast(floor(value) as int) as level, user_id as doc_id from {events}""",
}


def _needs(name: str, ready: Container[str] = ()) -> list[str]:
    """The derived tables that one reads, deepest first, itself last; of those that are ready no more than they."""
    out: list[str] = []
    for other in SQL if name not in ready else ():
        if other != name and re.search(rf"\b(from|join) {other}\b", SQL[name]):
            out += [x for x in _needs(other, ready) if x not in out]
    return [*out, name]


def reads(name: str, other: str) -> int:
    """How often a derived table's text reads ``other``, by way of further ones too."""
    if name == other:
        return 1
    times = {x: len(re.findall(rf"\b(?:from|join) {x}\b", SQL[name])) for x in SQL if x != name}
    return sum(n * reads(x, other) for x, n in times.items() if n)


def prelude(names: list[str]) -> str:
    """``with`` list of derived tables for the oracle."""
    order: list[str] = []
    for n in names:
        order += [x for x in _needs(n) if x not in order]
    parts = []
    for n in order:
        text = SQL[n].replace("{k}", "json_extract_string(props, '$.k')").replace(" as string)", " as varchar)")
        parts.append(f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', text)})")
    return ",\n".join(parts)


def bound(spark: SparkSession, sf_dir: str, name: str, ready: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """A derived table as a DataFrame; ``ready`` has the tables in Spark's catalog of those that have been written."""
    order = _needs(name, ready)
    parts = []
    for n in order:
        text = f"select * from {ready[n]}" if n in ready else SQL[n].replace("{k}", "get_json_object(props, '$.k')")
        parts.append(f"{n} as ({re.sub(r'[{](\w+)[}]', lambda m: f'parquet.`{sf_dir}/{m[1]}.parquet`', text)})")
    return spark.sql(f"with {', '.join(parts)} select * from {name}")
