"""Row mining: lines of a table section to channels and value ranges.

Sections are cut by headings; a section's lines are put in order and handled by window functions. Where a
decision depends on earlier decisions (the next expected number, ranges that clear those kept so far), a task
runs through its sections' sorted rows as a stream with one small state: linear in the rows, however long a section.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmine.functions.channels import relationship_key
from specmine.functions.text import RANGE, ascii_edges, clean_function, is_page_furniture, normalize_line, parse_range

FULL_ROW = rf"^([0-9]{{1,3}})\s+(?:[0-9-]{{1,3}}\s+)?{RANGE}\s+(.+)$"
RANGE_ONLY = rf"^{RANGE}\s+(.+)$"
NAME_ONLY = r"^([0-9]{1,3})\s+([A-Za-z].*)$"
HEADING = r"(?i)\b(channel table|channel mode|[0-9]+-channel mode|dmx values|dmx mode|ch function|function$|value$)"


def in_document():
    """Lines of a document in order."""
    return W.partitionBy("doc_id").orderBy("line_no")


def classify_lines(lines: DataFrame) -> DataFrame:
    """``kind`` of each line by ordered rules, with channel number, bounds and label."""
    t = normalize_line(F.col("text"))
    kind = (
        F.when(t.rlike(HEADING), "heading")
        .when(t.rlike(r"(?i)^(page|rev|user manual|contents?)\b"), "furniture")
        .when(t.rlike(FULL_ROW), "full_row")
        .when(t.rlike(RANGE_ONLY), "range_only")
        .when(t.rlike(r"^(\.{2,}|…)$"), "ellipsis")
        .when(t.rlike(NAME_ONLY), "name_only")
        .otherwise("other")
    )
    out = lines.withColumn("line", t).withColumn("kind", kind)
    full, part = F.col("kind") == "full_row", F.col("kind") == "range_only"
    get = lambda p, i: F.regexp_extract("line", p, i)
    return out.withColumns({
        "channel": F.when(full, get(FULL_ROW, 1)).when(F.col("kind") == "name_only", get(NAME_ONLY, 1)).try_cast("int"),
        "range_start": F.when(full, get(FULL_ROW, 2)).when(part, get(RANGE_ONLY, 1)).try_cast("int"),
        "range_end": F.when(full, get(FULL_ROW, 3)).when(part, get(RANGE_ONLY, 2)).try_cast("int"),
        "label": F.when(full, get(FULL_ROW, 4)).when(part, get(RANGE_ONLY, 3)).when(F.col("kind") == "name_only", get(NAME_ONLY, 2)),
    })


def sections(classified: DataFrame) -> DataFrame:
    """Number of the latest heading of each line's document, 0 ahead of the first."""
    return classified.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(in_document()).cast("int"))


def carry_channel(classified: DataFrame) -> DataFrame:
    """Range-only lines belong to the latest channel row of their section."""
    s = sections(classified)
    w = W.partitionBy("doc_id", "section").orderBy("line_no")
    return s.withColumn("position", F.last("channel", ignorenulls=True).over(w)).where("kind in ('full_row', 'range_only') and position is not null")


def rejoin_split_digits(lines: DataFrame) -> DataFrame:
    """Byte values split by the scanner ("1 28-255") are rejoined where the plain reading is no row."""
    again = F.regexp_replace("text", r"\b([0-9]) ([0-9]{1,2})\b", "$1$2")
    s = lines.withColumn("_again", again)
    changed = ~F.col("_again").eqNullSafe(F.col("text"))  # else both readings are one
    use = F.when(changed, parse_range(F.col("text")).isNull() & parse_range(F.col("_again")).isNotNull()).otherwise(False)
    s = s.withColumn("rejoined", use)
    return s.withColumn("fixed", F.when(F.col("rejoined"), F.col("_again")).otherwise(F.col("text"))).select(*lines.columns, "fixed", "rejoined")


def kept_in_order(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], rule: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows for which a group's rule holds, asked in order. ``rule()`` gives a fresh one for each group."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, holds = None, None
        for batch in batches:
            keep = []
            for key, values in zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*(batch.column(f).to_pylist() for f in fields))):
                if holds is None or key != group:
                    group, holds = key, rule()
                keep.append(holds(*values))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return sorted_rows.mapInArrow(run, sorted_rows.schema)


def next_number() -> Callable[[int], bool]:
    """Holds for the first number, and then for each that is the next one expected."""
    due: list[int] = []

    def holds(number: int) -> bool:
        if due and number != due[0]:
            return False
        due[:] = [number + 1]
        return True

    return holds


def clear_of_kept() -> Callable[[int, int], bool]:
    """Holds for a range that touches none of those for which it held before; they are kept sorted."""
    starts: list[int] = []
    ends: list[int] = []

    def holds(start: int, end: int) -> bool:
        i = bisect_right(starts, end)
        if i and ends[i - 1] >= start:
            return False
        starts.insert(i, start)
        ends.insert(i, end)
        return True

    return holds


def accept_in_sequence(rows: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """A row counts only if its number is the next one expected, from 1 (or the first number)."""
    return kept_in_order(rows.select(*keys, order, "channel"), keys, [order], ["channel"], next_number).select(*keys, order)


def row_cells(lines: DataFrame, width: int = 2) -> DataFrame:
    """Leading cells (numbers or dashes) of matrix lines and the rest of the line."""
    cell = r"(?:[0-9]{1,3}|-)"
    pattern = rf"^((?:{cell}\s+){{{width}}})({RANGE}\s+.*)$"
    hit = lines.where(F.col("text").rlike(pattern))
    return hit.select("doc_id", "page", "line_no", F.split(F.trim(F.regexp_extract("text", pattern, 1)), r"\s+").alias("cells"), F.regexp_extract("text", pattern, 2).alias("rest"))


def explode_matrix_rows(cells: DataFrame) -> DataFrame:
    """A line feeds every mode column that holds a number; the first line of a position wins."""
    long = cells.select("doc_id", "line_no", "rest", F.posexplode("cells").alias("mode_col", "cell")).where("cell <> '-'").withColumn("position", F.col("cell").cast("int"))
    w = W.partitionBy("doc_id", "mode_col", "position").orderBy("line_no")
    return long.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "mode_col", "position", "line_no", "rest")


def plausible_rows(cells: DataFrame, counts: Column) -> DataFrame:
    """Every cell within 1 and the size of its column; a null size is unbounded."""
    fits = F.zip_with("cells", counts, lambda c, n: (c == "-") | n.isNull() | (c.try_cast("int").between(1, n) & c.isNotNull()))
    return cells.withColumn("plausible", F.forall(fits, lambda x: F.coalesce(x, F.lit(True))))


def merge_split_rows(lines: DataFrame) -> DataFrame:
    """A line of leading cells alone is spliced to the next usable line of its document."""
    usable = lines.where(~F.col("text").rlike(r"(?i)^(page|user manual|\.{2,})"))
    bare = F.col("text").rlike(r"^([0-9]{1,3}|-)(\s+([0-9]{1,3}|-))*$")
    u = usable.withColumn("_bare", bare).withColumn("_next", F.lead("text").over(in_document())).withColumn("_eaten", F.coalesce(F.lag("_bare").over(in_document()), F.lit(False)))
    return u.where("not _eaten or _bare").select("doc_id", "line_no", F.when(F.col("_bare") & F.col("_next").isNotNull(), F.concat_ws("   ", "text", "_next")).otherwise(F.col("text")).alias("text"))


def infer_mode_size(positions: DataFrame) -> DataFrame:
    return positions.groupBy("doc_id", "mode_col").agg(F.max("position").alias("mode_size"))


def assign_ranges(carried: DataFrame) -> DataFrame:
    """A range extends the open channel until that covers 0 to 255 in order; what comes after
    waits for the next channel row. Ranges are taken until one reaches 255, so how far a channel
    reaches is the greatest end since its row."""
    w = W.partitionBy("doc_id", "section").orderBy("line_no")
    opened = carried.withColumn("_run", F.count("channel").over(w)).withColumn("_open", F.last("channel", ignorenulls=True).over(w))
    before = W.partitionBy("doc_id", "section", "_run").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    taken = opened.withColumn("_reach", F.coalesce(F.max("range_end").over(before), F.lit(-1))).where("_open is not null and _reach < 255")
    return taken.select("doc_id", "section", F.col("_open").alias("position"), "line_no", "range_start", "range_end")


def merge_channels(rows: DataFrame) -> DataFrame:
    """A mode position's channel: the first row, unless it is generic and a later one isn't."""
    best = F.min_by(F.struct("name", "kind", "channel_id"), F.struct(F.when(F.col("kind") == "generic", 1).otherwise(0), "channel_idx"))
    return rows.groupBy("doc_id", "mode_idx", "position").agg(best.alias("b"), F.count("*").alias("n_rows")).select("doc_id", "mode_idx", "position", "b.name", "b.kind", "b.channel_id", "n_rows")


def distinct_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of a channel without exact repeats; the first of equal bounds stays."""
    w = W.partitionBy("doc_id", "channel_id", "range_start", "range_end").orderBy("range_idx")
    return ranges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """In order of appearance, a range stays only if it clears all that stayed."""
    r = ranges.where("range_start <= range_end").select("doc_id", "channel_id", "range_idx", "range_start", "range_end")
    return kept_in_order(r, ["doc_id", "channel_id"], ["range_idx"], ["range_start", "range_end"], clear_of_kept)


def fill_missing_positions(rows: DataFrame) -> DataFrame:
    """Placeholders of confidence 0.25 for positions nothing was read for; of what was read, the first row's name, kind,
    colour and fine link (where the rows have one)."""
    link = F.col("fine_of") if "fine_of" in rows.columns else F.lit(None).cast("string")
    size = rows.groupBy("doc_id", "mode_idx").agg(F.max("position").alias("size"), F.count_distinct("position").alias("parsed"))
    every = size.select("doc_id", "mode_idx", "parsed", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("position"))
    first = rows.groupBy("doc_id", "mode_idx", "position").agg(F.min_by(F.struct("name", "confidence", "kind", "color", link.alias("fine_of")), F.col("channel_idx")).alias("f"))
    filled = every.join(first, ["doc_id", "mode_idx", "position"], "left")
    return filled.select("doc_id", "mode_idx", "position", "parsed", F.coalesce("f.name", F.concat(F.lit("Channel "), F.col("position").cast("string"))).alias("name"), F.coalesce("f.confidence", F.lit(0.25)).alias("confidence"), "f.kind", "f.color", "f.fine_of")


def in_mode():
    """Rows of a mode in order."""
    return W.partitionBy("doc_id", "mode_idx").orderBy("position", "channel_idx")


def pair_fine_channels(rows: DataFrame) -> DataFrame:
    """A fine row right behind a coarse one of its kind takes its name, colour and link."""
    fine = F.col("name").rlike(r"(?i)\b(fine|lsb|16.?bit)\b")
    r = rows.withColumn("is_fine", fine).withColumn("_p", F.lag(F.struct("name", "kind", "color", "channel_id", "is_fine")).over(in_mode()))
    linked = F.col("is_fine") & F.col("_p").isNotNull() & ~F.col("_p.is_fine") & (F.col("_p.kind") == F.col("kind"))
    return r.select("doc_id", "mode_idx", "position", "channel_idx", F.when(linked, F.concat("_p.name", F.lit(" fine"))).otherwise(F.col("name")).alias("name"), F.when(linked, F.col("_p.color")).otherwise(F.col("color")).alias("color"), F.when(linked, F.col("_p.channel_id")).alias("fine_of"))


WIDE_KINDS = ["colorIntensity", "intensity", "pan", "tilt", "zoom"]  # fixed values: kinds whose next byte may be fine


def infer_fine_gaps(filled: DataFrame) -> DataFrame:
    """A hole between a coarse row of a wide kind and another read row is its fine byte, and so is a row right behind
    it that links to a coarse one, begins with "fine" or is a bare number. A row that has become a fine byte has none itself:
    of rows in a row that could be one, every other is."""
    w = W.partitionBy("doc_id", "mode_idx").orderBy("position")
    hole = F.col("kind").isNull()
    f = filled.withColumn("_hole", hole).withColumn("_b", F.lag(F.struct("name", "kind", "color", "fine_of", "_hole")).over(w)).withColumn("_a", F.lead("_hole").over(w))
    coarse = F.coalesce(~F.col("_b._hole") & F.col("_b.fine_of").isNull() & F.col("_b.kind").isin(*WIDE_KINDS), F.lit(False))
    bare = F.col("fine_of").isNotNull() | F.lower("name").startswith("fine ") | ((F.col("kind") == "generic") & F.col("name").rlike("^[0-9]{1,3}$"))
    f = f.withColumn("_can", coarse & F.when(F.col("_hole"), F.coalesce(~F.col("_a"), F.lit(False))).otherwise(F.coalesce(bare, F.lit(False))))
    f = f.withColumn("_run", F.sum((~F.col("_can")).cast("int")).over(w))
    nth = F.sum(F.col("_can").cast("int")).over(W.partitionBy("doc_id", "mode_idx", "_run").orderBy("position"))
    is_fine = F.col("_can") & (nth % 2 == 1)
    own = lambda c: F.when(is_fine, F.col(f"_b.{c}")).otherwise(F.col(c)).alias(c)
    return f.select("doc_id", "mode_idx", "position", F.when(is_fine, F.concat("_b.name", F.lit(" fine"))).otherwise(F.col("name")).alias("name"), own("kind"), own("color"), is_fine.alias("inferred"))


def resolve_fine_of(rows: DataFrame) -> DataFrame:
    """A fine channel points at the latest earlier coarse one of its key in the mode."""
    fine = F.col("name").rlike(r"(?i)\b(fine|lsb)\b")
    key = relationship_key(F.col("kind"), F.col("color"), F.col("name"))
    r = rows.withColumn("is_fine", fine).withColumn("rel_key", key)
    w = W.partitionBy("doc_id", "mode_idx", "rel_key").orderBy("position", "channel_idx").rowsBetween(W.unboundedPreceding, -1)
    return r.withColumn("coarse_id", F.last(F.when(~F.col("is_fine"), F.col("channel_id")), ignorenulls=True).over(w)).where("is_fine").select("doc_id", "mode_idx", "position", "channel_idx", "rel_key", "coarse_id")


def guard_value_bleed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", F.when(F.col("name").rlike("^[0-9]+$"), F.concat(F.lit("Channel "), F.col("position").cast("string"))).otherwise(F.col("name")))


def expand_rgb_blocks(blocks: DataFrame) -> DataFrame:
    """ "N x RGB = M channels" as N triplets from a first position, numbered segments."""
    p = r"(?i)([0-9]{1,3})\s*x\s*(RGBW?)\s*=\s*([0-9]{1,3})\s*channels"
    b = blocks.where(F.col("text").rlike(p)).select("doc_id", "first", F.regexp_extract("text", p, 1).try_cast("int").alias("n"), F.upper(F.regexp_extract("text", p, 2)).alias("c"), F.regexp_extract("text", p, 3).try_cast("int").alias("m")).where("n * length(c) = m")
    e = b.select("doc_id", "first", "c", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("segment"))
    e = e.select("doc_id", "first", "c", "segment", F.posexplode(F.split("c", "")).alias("k", "letter")).where("letter <> ''")
    names = F.create_map(*map(F.lit, ["R", "Red", "G", "Green", "B", "Blue", "W", "White"]))
    return e.select("doc_id", (F.col("first") + (F.col("segment") - 1) * F.length("c") + F.col("k")).alias("position"), F.concat(names[F.col("letter")], F.lit(" "), F.col("segment").cast("string")).alias("name"))


# How manuals state blocks of pixels at the end of a mode, and their labels.
PIXELS = [
    ("Beam pixel", r"(?i)([0-9]{1,3})\s*x\s*RGB\s+channels?\s*=\s*([0-9]{1,4})\s+channels?\s+for\s+individual\s+RGB\s+Beam\s+pixel", 1, 2),
    ("Aura pixel", r"(?i)([0-9]{1,4})\s+channels?\s+for\s+individual\s+RGB\s+control\s+of\s+all\s+([0-9]{1,4})\s+Aura\s+pixels", 2, 1),
]
SEGMENTS = r"(?i)([0-9]{1,4})\s+channels?\s+for\s+Aura\s+control\s+in\s+segments"


def pixel_templates(sections: DataFrame) -> DataFrame:
    """Triplets of the pixel blocks that a section states, which end at its last channel; where blocks
    overlap the later statement stands. ``sections``: doc_id, mode_idx, text, size."""
    number = lambda p, g: F.regexp_extract("text", p, g).try_cast("int")
    parts = [(i, number(p, n), number(p, m), F.lit(label + " ")) for i, (label, p, n, m) in enumerate(PIXELS)]
    blocks = [F.struct(F.lit(i).alias("o"), n.alias("n"), m.alias("m"), label.alias("label")) for i, n, m, label in parts]
    size = number(SEGMENTS, 1)
    blocks.append(F.struct(F.lit(len(parts)).alias("o"), F.floor(size / 3).cast("int").alias("n"), size.alias("m"), F.lit(None).cast("string").alias("label")))
    b = sections.select("doc_id", "mode_idx", "size", F.explode(F.filter(F.array(*blocks), lambda x: x["n"] > 0)).alias("b"))
    e = b.select("doc_id", "mode_idx", "b.o", (F.col("size") - F.col("b.m") + 1).alias("start"), "b.label", F.explode(F.sequence(F.lit(1), F.col("b.n"))).alias("k"))
    segment = F.when(F.col("k") <= 37, F.concat(F.lit("Aura pixels around Beam pixel "), F.col("k").cast("string"))).when(F.col("k") == 38, "Inner Aura ring").when(F.col("k") == 39, "Second Aura ring").otherwise(F.concat(F.lit("Aura segment "), F.col("k").cast("string")))
    label = F.coalesce(F.concat("label", F.col("k").cast("string")), segment)
    t = e.select("doc_id", "mode_idx", "o", "start", "k", label.alias("label"), F.posexplode(F.array(*map(F.lit, ["Red", "Green", "Blue"]))).alias("c", "color"))
    t = t.select("doc_id", "mode_idx", "o", (F.col("start") + (F.col("k") - 1) * 3 + F.col("c")).alias("position"), F.concat_ws(" ", "label", "color").alias("name"))
    return t.groupBy("doc_id", "mode_idx", "position").agg(F.max_by("name", "o").alias("name"))


def fill_color_series(rows: DataFrame) -> DataFrame:
    """Numbered colour groups: the stride from the first two zones; gaps are filled only if every
    observation fits. ``rows``: doc_id, color, zone, position."""
    w = W.partitionBy("doc_id", "color").orderBy("zone")
    first = rows.withColumn("_k", F.row_number().over(w))
    a = first.where("_k = 1").select("doc_id", "color", F.col("zone").alias("z1"), F.col("position").alias("p1"))
    b = first.where("_k = 2").select("doc_id", "color", F.col("zone").alias("z2"), F.col("position").alias("p2"))
    t = a.join(b, ["doc_id", "color"]).where("z2 > z1 and (p2 - p1) % (z2 - z1) = 0").withColumn("stride", ((F.col("p2") - F.col("p1")) / (F.col("z2") - F.col("z1"))).cast("int"))
    fit = rows.join(t, ["doc_id", "color"]).groupBy("doc_id", "color", "z1", "p1", "stride").agg(F.bool_and(F.col("position") == F.col("p1") + (F.col("zone") - F.col("z1")) * F.col("stride")).alias("ok"), F.max("zone").alias("top")).where("ok and stride > 0")
    every = fit.select("doc_id", "color", F.explode(F.sequence("z1", "top")).alias("zone"), "z1", "p1", "stride").select("doc_id", "color", "zone", (F.col("p1") + (F.col("zone") - F.col("z1")) * F.col("stride")).alias("position"))
    return every.join(rows, ["doc_id", "color", "zone"], "left_anti")


def expand_ellipsis(blocks: DataFrame) -> DataFrame:
    """Blocks left out at a dotted row, if the unit is consecutive and the next block lands on a
    multiple. ``blocks``: doc_id, block (index or null for the dots), first, size, ord."""
    w = W.partitionBy("doc_id").orderBy("ord")
    s = F.struct("block", "first", "size")
    d = blocks.withColumn("_b", F.lag(s).over(w)).withColumn("_a", F.lead(s).over(w)).where("block is null and _b is not null and _a is not null")
    n = F.col("_a.block") - F.col("_b.block") - 1
    fits = (n > 0) & (F.col("_a.first") == F.col("_b.first") + (n + 1) * F.col("_b.size"))
    e = d.where(fits).select("doc_id", "_b", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    return e.select("doc_id", (F.col("_b.block") + F.col("i")).alias("block"), (F.col("_b.first") + F.col("i") * F.col("_b.size")).alias("first"), F.col("_b.size").alias("size"))


def block_rows(classified: DataFrame) -> DataFrame:
    """A named row opens a block and range-only rows follow; blocks with their bounds."""
    s = sections(classified).where("kind in ('full_row', 'range_only', 'name_only')")
    w = W.partitionBy("doc_id", "section").orderBy("line_no")
    opened = s.withColumn("block", F.sum(F.col("kind").isin("full_row", "name_only").cast("int")).over(w).cast("int"))
    return opened.groupBy("doc_id", "section", "block").agg(F.min_by("label", "line_no").alias("name"), F.first("channel", ignorenulls=True).alias("position"), F.min("range_start").alias("low"), F.max("range_end").alias("high"), F.count("*").alias("n_lines"))


def fold_unplaced_blocks(blocks: DataFrame) -> DataFrame:
    """A block without position joins the neighbour its values continue: the one before if it
    ends right below, else the one after."""
    w = W.partitionBy("doc_id", "section").orderBy("block")
    b = blocks.withColumn("_b", F.lag(F.struct("position", "high")).over(w)).withColumn("_a", F.lead(F.struct("position", "low")).over(w))
    goes = F.when(F.col("position").isNotNull(), F.col("position")).when(F.col("_b.high") + 1 == F.col("low"), F.col("_b.position")).when(F.col("high") + 1 == F.col("_a.low"), F.col("_a.position"))
    return b.select("doc_id", "section", "block", "name", goes.alias("position"))


def continued_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of one position united: first label, outer bounds, lines summed."""
    return blocks.where("position is not null").groupBy("doc_id", "position").agg(F.min_by("name", F.struct("section", "block")).alias("name"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_lines").alias("n_lines"))


def appendix_ranges(lines: DataFrame, heading: str = "(?i)dmx channel table", limit: int = 8000) -> DataFrame:
    """Range lines under a heading, up to the next heading and so many characters."""
    c = classify_lines(lines)
    head = F.col("text").rlike(heading)
    run = F.sum(F.length("text") + 1).over(in_document())
    c = c.withColumn("_at", run).withColumn("_from", F.when(head, run)).withColumn("_from", F.last("_from", ignorenulls=True).over(in_document()))
    c = c.withColumn("_stop", F.when((F.col("kind") == "heading"), head)).withColumn("_in", F.last("_stop", ignorenulls=True).over(in_document()))
    r = parse_range(F.col("line"))
    return c.where("_in and kind in ('range_only', 'full_row')").where(F.col("_at") - F.col("_from") <= limit).withColumn("r", r).where("r is not null").select("doc_id", "line_no", "r.start", "r.end", "r.label")


# Value tables in a manual's appendix (key, heading, what ends them), and the channel names that they belong to.
APPENDICES = [("shutter", r"Shutter", r"Mode\s+table\s*[2②]"), ("virtual-color-wheel", r"Virtual colou?r wheel\*?", r"(?:[0-9]{1,4}\s+)?(?:Zoom|Beamshaper|Pan / tilt|Compact DMX Mode)\*?")]
APPENDIX_OF = {"shutter / strobe": "shutter", "color temperature": "color-temperature", "mode table 1": "mode-1", "mode table 2": "mode-2", "background color": "background-color", "virtual color wheel": "virtual-color-wheel"}


def appendix_sections(lines: DataFrame, appendices: list[tuple[str, str, str]] = APPENDICES, limit: int = 8000) -> DataFrame:
    """(doc_id, key, line_no, range_start, range_end, name, safety): range lines from an appendix heading to what ends it, if
    that comes within so many characters; of several headings of a key the first that has an end."""
    w, text = in_document(), F.col("text")
    at = F.sum(F.length("text") + 1).over(w)
    row = r"^\s*(?:[0-9]{1,3}\s+)?([0-9]{1,3})\s*[-–—]\s*([0-9]{1,3})\s+(.+?)\s*$"
    out = []
    for key, heading, stop in appendices:
        head, end = text.rlike(rf"(?i)^\s*{heading}\s*$"), text.rlike(rf"(?i)^\s*{stop}\s*$")
        s = lines.withColumn("_at", at).withColumn("_from", F.last(F.when(head, F.struct("line_no", F.col("_at").alias("at"))), ignorenulls=True).over(w)).where("_from is not null")
        section = W.partitionBy("doc_id", "_from.line_no")
        s = s.withColumn("_end", F.min(F.when(end & (F.col("line_no") > F.col("_from.line_no")) & (F.col("_at") - F.length("text") - 1 - F.col("_from.at") < limit), F.col("line_no"))).over(section)).where("_end is not null")
        s = s.withColumn("_first", F.min("_from.line_no").over(W.partitionBy("doc_id"))).where("_from.line_no = _first and line_no > _first and line_no < _end").where(text.rlike(row))
        read = F.struct(F.regexp_extract("text", row, 1).try_cast("int").alias("range_start"), F.regexp_extract("text", row, 2).try_cast("int").alias("range_end"), clean_function(F.regexp_extract("text", row, 3)).alias("name"))
        # behind explode, so that no later filter reads the line again
        out.append(s.select("doc_id", F.lit(key).alias("key"), "line_no", F.explode(F.array(read)).alias("_x")).select("doc_id", "key", "line_no", "_x.*"))
    every = reduce(DataFrame.unionByName, out).where("range_start <= range_end and range_end <= 255 and name <> ''").where(~is_page_furniture(F.col("name")))
    low = F.lower("name")
    return every.withColumn("safety", F.when(low.contains("strobe") & ~low.contains("off"), "strobe").otherwise("normal"))


def attach_appendix(sections: DataFrame, channels: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges of an appendix for each channel that it belongs to, by the channel's name; a strobe channel with one range
    over all values has the shutter's."""
    one = ranges.groupBy("doc_id", "channel_id").agg(F.count("*").alias("_n"), F.min("range_start").alias("_lo"), F.max("range_end").alias("_hi"))
    undivided = (F.col("kind") == "strobe") & (F.col("_n") == 1) & (F.col("_lo") == 0) & (F.col("_hi") == 255)
    named = F.create_map(*[F.lit(x) for kv in APPENDIX_OF.items() for x in kv])
    key = F.when(undivided, "shutter").otherwise(F.try_element_at(named, F.lower("name")))
    c = channels.join(one, ["doc_id", "channel_id"], "left").select("doc_id", "channel_idx", "channel_id", key.alias("key")).where("key is not null")
    return c.join(sections, ["doc_id", "key"]).select("doc_id", "channel_idx", "channel_id", "line_no", "range_start", "range_end", "name", "safety", F.lit(0.95).alias("confidence"))


def default_ranges(channels: DataFrame, ranges: DataFrame) -> DataFrame:
    """A full range for channels that have none; surer for kinds without risk."""
    none = channels.join(ranges, ["doc_id", "channel_id"], "left_anti")
    safety = F.when(F.col("kind") == "strobe", "strobe").when(F.col("kind") == "maintenance", "reset").otherwise("normal")
    return none.select("doc_id", "channel_idx", "channel_id", F.lit(0).alias("range_start"), F.lit(255).alias("range_end"), F.when(F.col("kind") == "intensity", "Brightness").otherwise("Full range").alias("name"), safety.alias("safety"), F.when(F.col("kind").isin("strobe", "maintenance"), 0.45).otherwise(0.8).alias("confidence"))


def wheel_slots(docs: DataFrame, channels: DataFrame) -> DataFrame:
    """Slots (2 to 64) of wheels named in the text, linked to the document's wheel channels."""
    n = lambda w: F.regexp_extract("text", rf"(?i)([0-9]{{1,2}}) {w}", 1).try_cast("int")
    kinds = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("goboWheel").alias("kind"), n("gobos?").alias("n")), F.struct(F.lit("colorWheel").alias("kind"), n("colou?rs?").alias("n")))).alias("k")).select("doc_id", "k.kind", "k.n").where("n between 2 and 64")
    slots = kinds.select("doc_id", "kind", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    w = channels.where("kind in ('goboWheel', 'colorWheel')").select("doc_id", "kind", "channel_id")
    return w.join(slots, ["doc_id", "kind"]).select("doc_id", "channel_id", F.concat_ws("-", "channel_id", "kind").alias("wheel_id"), "slot", F.concat(F.lit("Slot "), F.col("slot").cast("string")).alias("name"))


def assign_ids(channels: DataFrame) -> DataFrame:
    """Unique ids; repeated codes get a suffix and a display "(n)"."""
    w = W.partitionBy("doc_id", "channel_id").orderBy("channel_idx")
    c = channels.withColumn("_n", F.row_number().over(w))
    again = F.col("_n") > 1
    return c.select("doc_id", "channel_idx", F.when(again, F.concat("channel_id", F.lit("-"), F.lpad(F.col("_n").cast("string"), 2, "0"))).otherwise(F.col("channel_id")).alias("channel_id"), F.when(again, F.concat("name", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"))


def split_breaks(rows: DataFrame) -> DataFrame:
    """Slot index to break and offset in blocks of 512."""
    return rows.select("*", (F.floor((F.col("slot") / 512)) + 1).cast("int").alias("dmx_break"), (F.col("slot") % 512 + 1).cast("int").alias("channel_offset"))


def unstructured_modes(sizes: DataFrame, channels: DataFrame) -> DataFrame:
    """Without tables, modes are prefixes of one channel list, named by their size."""
    c = channels.select("doc_id", (F.col("channel_idx") + 1).alias("position"), "channel_id")
    return sizes.join(c, "doc_id").where("position <= size").select("doc_id", F.concat(F.col("size").cast("string"), F.lit("-channel")).alias("mode_name"), "position", "channel_id")


# Controls looked for anywhere in a text, and how fine bytes of a position and colours are written.
COMPONENTS = [
    ("Pan", r"(?i)\bpan\b"), ("Tilt", r"(?i)\btilt\b"), ("Pan / tilt speed", r"(?i)((pan.?tilt|x.?y)\s+speed|speed\s+from\s+100)"), ("Dimmer", "(?i)dimm(ing|er)"), ("Light switch / strobe", r"(?i)(light switch.?strobe|\bstrobe\b)"),
    ("Color wheel", "(?i)color wheel"), ("Gobo wheel", "(?i)gobo wheel"), ("Prism", r"(?i)\bprism\b"), ("Reserved", "(?i)reserved channel"), ("Reset / function", "(?i)reset.?function channel"),
]
POSITION_FINE = r"(?i)(pan\s+fine|tilt\s+fine|[xy][ -]?axis\s+fine|16[ -]?bit(?:\s+precision)?\s+scan)"
SIGNATURE = "RGB(?:W)?(?:A)?(?:UV)?"
SIGNED = [("Red", "RGB"), ("Green", "RGB"), ("Blue", "RGB"), ("White", "W"), ("Amber", "A"), ("UV", "UV")]


def component_scan(docs: DataFrame, components: list[tuple[str, str]] = COMPONENTS) -> DataFrame:
    """Components whose pattern occurs anywhere in the text, in one pass over it; fine bytes of pan and tilt where the text
    speaks of a fine position; and, without a colour wheel, the colours of the first signature (RGB, then W, A, UV) in the
    text's small letters and digits put together."""
    text = F.regexp_replace("text", r"\s+", " ")
    d = docs.select("doc_id", text.alias("text")).withColumn("_sign", F.regexp_extract(F.upper(F.regexp_replace("text", "[^a-z0-9]+", "")), SIGNATURE, 0))
    has = lambda p: F.col("text").rlike(ascii_edges(p))
    found = [F.when(has(p), F.lit(n)) for n, p in components]
    fine = [F.when(has(POSITION_FINE) & has(rf"(?i)\b{n}\b"), F.lit(f"{n.capitalize()} fine")) for n in ("pan", "tilt")]
    colours = [F.when(~has("(?i)color wheel") & F.col("_sign").contains(letters), F.lit(n)) for n, letters in SIGNED]
    return d.select("doc_id", F.explode(F.array_compact(F.array(*found, *fine, *colours))).alias("component"))


def table_channels_fallback(classified: DataFrame, counts: DataFrame) -> DataFrame:
    """The section with most rows in sequence wins, the later on ties, if it has 4 or more and at least half the
    document's channel count (``counts``: doc_id, channel_count)."""
    s = sections(classified).where("channel is not null and kind in ('full_row', 'name_only')")
    kept = accept_in_sequence(s, ["doc_id", "section"])
    found = kept.groupBy("doc_id", "section").agg(F.count("*").alias("n_rows"))
    w = W.partitionBy("doc_id").orderBy(F.desc("n_rows"), F.desc("section"))
    best = found.withColumn("_r", F.row_number().over(w)).where("_r = 1 and n_rows >= 4")
    return best.join(counts, "doc_id").where("2 * n_rows >= channel_count").select("doc_id", "section", "n_rows")


def recover_ordered_rows(classified: DataFrame) -> DataFrame:
    """Range rows that lost their number take the next position of their section, with less
    confidence; numbered rows keep theirs."""
    w = W.partitionBy("doc_id", "section").orderBy("line_no")
    s = sections(classified).where("kind in ('full_row', 'range_only')").withColumn("_run", F.count("channel").over(w))
    run = W.partitionBy("doc_id", "section", "_run").orderBy("line_no")
    since = F.coalesce(F.first("channel", ignorenulls=True).over(run) - 1, F.lit(0)) + F.row_number().over(run)
    return s.select("doc_id", "section", "line_no", since.alias("position"), F.when(F.col("channel").isNotNull(), 0.7).otherwise(0.6).alias("confidence"))
