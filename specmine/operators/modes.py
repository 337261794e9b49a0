"""Mode and table discovery: declared sizes, headings of each grammar, the grammar chosen."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from specmine.functions.text import RANGE
from specmine.operators.rows import in_document

# Number words, and heading patterns of the grammars in order of preference.
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
DECLARED = r"(?i)\b([0-9]{1,3})[ -]?(?:ch|channels?|dmx channels?)\b"
TABLE = r"(?i)\b(dmx channel table|channel mode|dmx values|dmx channels)\b|(?i)ch function$"
GRAMMARS = {"named": 1, "labelled": 2, "sparse": 3, "index_total": 4, "traits": 5, "sequential": 6, "contextual": 7, "coded": 8}


def declared_mode_counts(lines: DataFrame) -> DataFrame:
    """Distinct counts from 1 to 512, in the order first seen."""
    hits = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(DECLARED), F.lit(1))).alias("k", "n"))
    words = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBERS) for x in (w, str(i + 1))])
    spelt = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b({'|'.join(NUMBERS)})[ -]channel"), F.lit(1))).alias("k", "w")).select("doc_id", "line_no", "k", words[F.col("w")].alias("n"))
    counts = hits.unionByName(spelt).withColumn("n", F.col("n").cast("int")).where("n between 1 and 512")
    first = counts.groupBy("doc_id", "n").agg(F.min(F.struct("line_no", "k")).alias("at"))
    return first.select("doc_id", F.col("n").alias("size"), F.row_number().over(W.partitionBy("doc_id").orderBy("at", "n")).alias("seen"))


def sections_by_heading(lines: DataFrame, pattern: str = TABLE, stop: str = r"(?i)user manual") -> DataFrame:
    """Each line with the number and text of the latest matching heading; a stop heading ends it."""
    head, end = F.col("text").rlike(pattern), F.col("text").rlike(stop)
    mark = F.when(head, F.col("text")).when(end, F.lit(""))
    s = lines.withColumn("section", F.sum((head | end).cast("int")).over(in_document()).cast("int")).withColumn("heading", F.last(mark, ignorenulls=True).over(in_document()))
    return s.where("heading is not null and heading <> ''")


def table_row_count(lines: DataFrame, limit: int = 30_000) -> DataFrame:
    """The longest run 1..n of row numbers under a heading, within so many characters."""
    s = sections_by_heading(lines).withColumn("_len", F.sum(F.length("text") + 1).over(W.partitionBy("doc_id", "section").orderBy("line_no"))).where(F.col("_len") <= limit)
    n = s.withColumn("v", F.regexp_extract("text", r"^([0-9]{1,3})\s", 1).try_cast("int")).where("v is not null").select("doc_id", "section", "v").distinct()
    runs = n.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "section").orderBy("v"))).where("v = _r")
    return runs.groupBy("doc_id", "section").agg(F.max("v").alias("n")).groupBy("doc_id").agg(F.max("n").alias("table_count"))


def reconcile_counts(declared: DataFrame, tables: DataFrame, pixels: DataFrame) -> DataFrame:
    """The table's count (4 or more) joins the declared ones, replaces a single one of more than
    twice its size (not of a pixel matrix), or is ignored beside two or more."""
    n = declared.groupBy("doc_id").agg(F.count("*").alias("k"), F.max("size").alias("top"))
    t = tables.where("table_count >= 4").join(n, "doc_id", "left").join(pixels.select("doc_id", F.lit(True).alias("px")), "doc_id", "left")
    replaces = (F.col("k") == 1) & (F.col("top") > 2 * F.col("table_count")) & F.col("px").isNull()
    use = t.where(F.col("k").isNull() | (F.col("k") == 1)).select("doc_id", F.col("table_count").alias("size"), F.coalesce(replaces, F.lit(False)).alias("replaces"))
    kept = declared.join(use.where("replaces").select("doc_id"), "doc_id", "left_anti").select("doc_id", "size")
    return kept.unionByName(use.select("doc_id", "size")).distinct()


def ints(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def _headers(lines: DataFrame, counts: Column, where: Column) -> DataFrame:
    return lines.where(where).select("doc_id", "page", "line_no", counts.alias("counts"))


def header_labeled(lines: DataFrame) -> DataFrame:
    """ "3Ch 12Ch 28Ch Function": two labelled columns or more."""
    counts = ints(F.col("text"), r"(?i)\b([0-9]{1,3}) ?ch\b")
    return _headers(lines, counts, F.col("text").rlike("(?i)function") & (F.size(counts) >= 2))


def text_above(lines: DataFrame, chars: int) -> DataFrame:
    """Lines with ``_above``: the last so many characters of the document's text ahead of the line."""
    s = lines.withColumn("_at", F.coalesce(F.sum(F.length("text") + 1).over(in_document().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    by_place = W.partitionBy("doc_id").orderBy("_at")
    s = s.withColumn("_near", F.collect_list("text").over(by_place.rangeBetween(-chars, -1))).withColumn("_cut", F.last("text").over(by_place.rangeBetween(W.unboundedPreceding, -chars - 1)))
    above = F.concat(F.array_join(F.array_compact(F.concat(F.array("_cut"), "_near")), "\n"), F.when(F.col("_at") > 0, "\n").otherwise(""))
    return s.withColumn("_above", F.right(above, F.least(F.lit(chars), F.length(above)))).drop("_at", "_near", "_cut")


def header_sparse(lines: DataFrame, above: int = 500) -> DataFrame:
    """2 to 8 bare distinct counts ahead of "Function", if some header of the document has a legend ("12: Name") in the
    characters above it."""
    p = r"(?i)^[ \t]*([0-9]{1,3}(?:[ \t]+[0-9]{1,3}){1,7})[ \t]+function\b"
    counts = ints(F.regexp_extract("text", p, 1), "([0-9]{1,3})")
    h = text_above(lines, above).where(F.col("text").rlike(p)).withColumn("counts", counts).where("size(array_distinct(counts)) = size(counts)")
    trusted = F.max(F.col("_above").rlike(r"[0-9]{1,3}\s*:\s*[A-Za-z]").cast("int")).over(W.partitionBy("doc_id"))
    return h.withColumn("_t", trusted).where("_t = 1").select("doc_id", "page", "line_no", "counts")


def header_index_total(lines: DataFrame, above: int = 400) -> DataFrame:
    """ "1/5 2/28 Value" (mode and total) or bare mode numbers ahead of "Value", with a "Mode/channel" label in the characters
    above; bare ones have unknown totals."""
    total, bare = r"^[ \t]*((?:[0-9]{1,2}/[0-9]{1,3}[ \t]+){1,7})Value\b", r"^[ \t]*((?:[0-9]{1,2}[ \t]+){1,7})Value\b"
    label = F.col("_above").rlike(r"(?i)Mode\s*/\s*(?:Total\s+)?channels?\b")
    t, b = F.regexp_extract("text", total, 1), F.regexp_extract("text", bare, 1)
    counts = F.when(t != "", ints(t, "/([0-9]{1,3})")).otherwise(F.transform(ints(b, "([0-9]{1,2})"), lambda x: F.lit(None).cast("int")))
    return _headers(text_above(lines, above), counts, ((t != "") | (b != "")) & label)


def header_traits(lines: DataFrame) -> DataFrame:
    """2 to 16 labelled distinct sizes with letter variants ("12ChA 12ChB"), or sizes stacked
    above their units."""
    p = r"(?i)\b([0-9]{1,3}) ?ch[a-z]?\b"
    own = F.regexp_extract_all("text", F.lit(r"(?i)\b([0-9]{1,3} ?ch[a-z]?)\b"), F.lit(1))
    below = F.lead("text").over(in_document())
    stacked = F.col("text").rlike(r"^([0-9]{1,3}\s*){2,16}$") & F.lower("_below").rlike(r"^(ch\s*){2,16}$")
    counts = F.when(stacked, ints(F.col("text"), "([0-9]{1,3})")).otherwise(ints(F.col("text"), p))
    good = (stacked | ((F.size(own) >= 2) & (F.size(F.array_distinct(F.transform(own, lambda x: F.lower(x)))) == F.size(own)))) & F.size(counts).between(2, 16) & F.forall(counts, lambda n: n.between(1, 512))
    return _headers(lines.withColumn("_below", below), counts, good)


def merge_header_runs(headers: DataFrame, tolerance: int = 0) -> DataFrame:
    """Consecutive headers of equal counts are one table; with a tolerance, of so many counts that
    differ, the larger count of each column."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    prev = F.lag("counts").over(w)
    differ = F.size(F.filter(F.zip_with("counts", "_p", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    new = F.col("_p").isNull() | (F.size("_p") != F.size("counts")) | (differ > tolerance)
    runs = headers.withColumn("_p", prev).withColumn("run", F.sum(new.cast("int")).over(w).cast("int"))
    long = runs.select("doc_id", "run", "line_no", F.posexplode("counts").alias("col", "n"))
    best = long.groupBy("doc_id", "run", "col").agg(F.max("n").alias("n"), F.min("line_no").alias("line_no"))
    return best.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.transform(F.array_sort(F.collect_list(F.struct("col", "n"))), lambda s: s["n"]).alias("counts"))


def sequential_headings(lines: DataFrame) -> DataFrame:
    """ "N-channel mode" anywhere in a line; two headings or a channel-table title are needed."""
    n = F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\b([0-9]{1,3})[ -]channel mode"), F.lit(1)))
    h = lines.select("doc_id", "line_no", n.alias("n")).select("doc_id", "line_no", F.col("n").cast("int").alias("size"))
    titled = lines.where(F.col("text").rlike("(?i)channel table")).select("doc_id").distinct()
    several = h.groupBy("doc_id").count().where("count >= 2").select("doc_id")
    return h.join(several.union(titled).distinct(), "doc_id", "left_semi").groupBy("doc_id", "size").agg(F.min("line_no").alias("line_no"))


def coded_headings(lines: DataFrame) -> DataFrame:
    """Coded table titles with words the scanner may have misread; the code in normal form."""
    p = r"(?i)\bt[a4]b[l1i]e\s+([0-9]{1,3})\s*([A-Z0-9]{0,3})\b"
    code = F.upper(F.concat(F.regexp_extract("text", p, 1), F.regexp_extract("text", p, 2)))
    return lines.where(F.col("text").rlike(p)).select("doc_id", "line_no", F.regexp_extract("text", p, 1).try_cast("int").alias("size"), code.alias("code"))


def collapse_code_aliases(codes: DataFrame) -> DataFrame:
    """A code of digits alone folds into the single coded one of its size; one that is a character
    short of, or a G for a C from, exactly one code of its size folds into that."""
    c = codes.select("doc_id", "size", "code").distinct()
    a, b = c.alias("a"), c.alias("b")
    digits = F.col("a.code").rlike("^[0-9]+$") & ~F.col("b.code").rlike("^[0-9]+$")
    misread = (F.length("a.code") == F.length("b.code") - 1) & (F.levenshtein("a.code", "b.code") == 1) & ~F.col("a.code").rlike("^[0-9]+$")
    swapped = (F.translate("a.code", "G", "C") == F.col("b.code")) & (F.col("a.code") != F.col("b.code"))
    near = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.code") != F.col("b.code")) & (digits | misread | swapped))
    one = near.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.size").alias("size"), F.col("a.code").alias("code")).agg(F.count("*").alias("n"), F.min("b.code").alias("canonical")).where("n = 1")
    return c.join(one, ["doc_id", "size", "code"], "left").select("doc_id", "size", "code", F.coalesce("canonical", "code").alias("canonical"))


def named_headings(lines: DataFrame) -> DataFrame:
    """ "<Name> DMX Mode" with "N DMX channels" on the next line; two or more are needed."""
    nxt = F.lead("text").over(in_document())
    h = lines.withColumn("_n", nxt).where(F.col("text").rlike("^[A-Z][a-z]+ DMX Mode$") & F.col("_n").rlike("^[0-9]{1,3} DMX channels$"))
    h = h.select("doc_id", "line_no", F.regexp_extract("text", "^([A-Z][a-z]+)", 1).alias("name"), F.regexp_extract("_n", "^([0-9]+)", 1).try_cast("int").alias("size"))
    return h.withColumn("_k", F.count("*").over(W.partitionBy("doc_id"))).where("_k >= 2").drop("_k")


# Headings of named modes, the lines that name a parent, and what ends a mode's section.
NAMED = r"(?i)^\s*([A-Za-z][A-Za-z0-9 /-]{1,48}?)\s+DMX\s+Mode\s*$"
COUNTED = r"(?i)^\s*([0-9]{1,4})\s+DMX\s+channels?\b"
AS_IN = r"(?i)Channels?\s+1\s*[-–—]\s*([0-9]{1,4})\s+as\s+in\s+(.+?)\s+Mode"
SUPPLEMENT = r"(?i)^\s*(?:Control/Settings DMX channel|FX list)\s*$"


def mode_name_key(c: Column) -> Column:
    """Blind to case and punctuation."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def named_modes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modes of documents with two named headings or more (mode_idx, name, size, and of the parent that the text
    names its parent_idx and prefix), and the rows of each mode's own section (mode_idx, position, channel_id)."""
    head = F.col("text").rlike(NAMED) & F.coalesce(F.col("_next").rlike(COUNTED), F.lit(False))
    s = lines.withColumn("_next", F.lead("text").over(in_document())).withColumn("_head", head)
    s = s.withColumn("mode_idx", F.sum(F.col("_head").cast("int")).over(in_document()).cast("int") - 1)
    s = s.withColumn("_over", F.last(F.when(F.col("text").rlike(SUPPLEMENT), F.col("mode_idx")), ignorenulls=True).over(in_document()))
    s = s.where("mode_idx >= 0 and (_over is null or _over < mode_idx)")
    part = lambda p, i: F.regexp_extract("text", p, i)
    title = F.array_join(F.transform(F.split(part(NAMED, 1), r"\s+"), lambda w: F.when(F.upper(w).isin("PXL", "RGB", "DMX"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")
    stated = F.when(F.col("_as_in"), F.struct("line_no", part(AS_IN, 1).try_cast("int").alias("prefix"), mode_name_key(part(AS_IN, 2)).alias("parent")))
    m = s.withColumn("_as_in", F.col("text").rlike(AS_IN)).where("_head or _as_in")  # every mode has its heading
    m = m.groupBy("doc_id", "mode_idx").agg(F.max(F.when(F.col("_head"), title)).alias("name"), F.max(F.when(F.col("_head"), F.regexp_extract("_next", COUNTED, 1).try_cast("int"))).alias("size"), F.min(stated).alias("p"))
    m = m.withColumn("_n", F.max("mode_idx").over(W.partitionBy("doc_id"))).where("_n >= 1 and size between 1 and 32768")
    m = m.select("doc_id", "mode_idx", "name", "size", "p.prefix", "p.parent", mode_name_key(F.col("name")).alias("key"))
    # each mode stands once under its own name and once under its parent's, whose latest owner before it is the parent
    told = F.explode(F.array(F.struct(F.col("key").alias("k"), F.lit(False).alias("asks")), F.struct(F.col("parent").alias("k"), F.lit(True).alias("asks"))))
    m = m.withColumn("_t", told).select("*", "_t.k", "_t.asks")
    earlier = W.partitionBy("doc_id", "k").orderBy("mode_idx").rangeBetween(W.unboundedPreceding, -1)
    m = m.withColumn("parent_idx", F.max(F.when(~F.col("asks"), F.col("mode_idx"))).over(earlier)).where("asks")
    m = m.select("doc_id", "mode_idx", "name", "size", F.when(F.col("k").isNotNull(), F.col("parent_idx")).alias("parent_idx"), "prefix")
    row = rf"^\s*([0-9]{{1,4}})\s+{RANGE}\s+(.+)$"
    rows = s.where(F.col("text").rlike(row)).select("doc_id", "mode_idx", "line_no", part(row, 1).try_cast("int").alias("position"), part(row, 4).alias("channel_id"))
    rows = rows.join(m.select("doc_id", "mode_idx", "size", "prefix"), ["doc_id", "mode_idx"]).where("position > coalesce(prefix, 0) and position <= size")
    rows = rows.groupBy("doc_id", "mode_idx", "position").agg(F.min_by("channel_id", "line_no").alias("channel_id"))
    return m, rows


def mode_ancestors(modes: DataFrame) -> DataFrame:
    """(doc_id, mode_idx, ancestor, upto, depth): each mode itself and all whose rows it inherits, with the least prefix on
    the way. Parents are earlier modes, so one pass over a document's modes in order reaches any depth; a parent that isn't
    earlier (a cycle) is none."""
    link = "struct<ancestor:int,upto:int>"
    start = F.array().cast(f"array<struct<mode_idx:int,up:array<{link}>>>")

    def step(done: Column, m: Column) -> Column:
        known = F.get(F.filter(done, lambda d: d["mode_idx"] == m["parent_idx"]), F.lit(0))["up"]
        alone = F.array(F.struct(m["parent_idx"].alias("ancestor"), F.lit(2**31 - 1).alias("upto")))  # a parent of which only rows are known
        above = F.when(m["parent_idx"] < m["mode_idx"], F.coalesce(known, alone))
        cut = F.transform(F.coalesce(above, F.array().cast(f"array<{link}>")), lambda a: F.struct(a["ancestor"].alias("ancestor"), F.least(a["upto"], m["prefix"]).alias("upto")))
        own = F.struct(m["mode_idx"].alias("ancestor"), F.lit(2**31 - 1).alias("upto"))
        return F.concat(done, F.array(F.struct(m["mode_idx"].alias("mode_idx"), F.concat(F.array(own), cut).alias("up"))))

    each = F.struct(F.col("mode_idx").cast("int").alias("mode_idx"), F.col("parent_idx").cast("int").alias("parent_idx"), F.coalesce(F.col("prefix").cast("int"), F.lit(0)).alias("prefix"))
    d = modes.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("m"))
    d = d.select("doc_id", F.explode(F.aggregate("m", start, step)).alias("d"))
    return d.select("doc_id", "d.mode_idx", F.posexplode("d.up").alias("depth", "a")).select("doc_id", "mode_idx", "a.ancestor", "a.upto", "depth")


def inherit_modes(modes: DataFrame, rows: DataFrame) -> DataFrame:
    """Positions that a mode lacks come from its parent (an earlier mode), that one's parent and so on, up to the prefix
    sizes on the way; the nearest rows win. ``modes``: doc_id, mode_idx, parent_idx, prefix."""
    own = rows.select("doc_id", "mode_idx", "position", "channel_id")
    above = mode_ancestors(modes).where("depth > 0").join(own.withColumnRenamed("mode_idx", "ancestor"), ["doc_id", "ancestor"]).where("position <= upto")
    reached = own.withColumn("depth", F.lit(0)).unionByName(above.drop("ancestor", "upto"))
    nearest = F.rank().over(W.partitionBy("doc_id", "mode_idx", "position").orderBy("depth"))
    return reached.withColumn("_r", nearest).where("_r = 1").select("doc_id", "mode_idx", "position", "channel_id")


# Headings of the contexts of personalities, with the names that are shown, and of their groups.
CONTEXTS = {"single control mode": "Single Control", "dual control mode - movement": "Dual Control · Movement", "dual control mode - pixels": "Dual Control · Pixels"}
CONTEXT = r"(?i)^\s*(Single Control Mode|Dual Control Mode\s*-\s*Movement|Dual Control Mode\s*-\s*Pixels)\s*$"
GROUP = r"(?i)^\s*([A-Za-z][A-Za-z0-9 ]*?\s*\([0-9]{1,3}CH\)(?:\s*/\s*[A-Za-z][A-Za-z0-9 ]*?\s*\([0-9]{1,3}CH\))*)\s*$"
PERSONALITY = r"(?i)([A-Za-z][A-Za-z0-9 ]*?)\s*\(([0-9]{1,3})CH\)"
HEADER_CHARS, HEADER_LINES = 500, 9


def column_order(names: list[str], header: list[str]) -> list[int]:
    """The column of each personality, by where its name stands across the header lines; as listed where one can't be found
    or two stand within two characters of each other."""
    at = [header_centre(n, header) for n in names]
    listed = list(range(len(names)))
    if any(x is None for x in at):
        return listed
    by_place = sorted(listed, key=lambda i: at[i])
    if any(at[b] - at[a] < 2 for a, b in zip(by_place, by_place[1:])):
        return listed
    return [by_place.index(i) for i in listed]


def header_centre(name: str, header: list[str]) -> float | None:
    """The mean centre of the name's parts, each at its place nearest to those before; None if a part is missing or they are
    more than 8 characters apart."""
    chosen: list[float] = []
    for part in re.sub(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ", name).split():
        places = [m.start() + len(part) / 2 for line in header for m in re.finditer(rf"\b{re.escape(part)}\b", line, re.IGNORECASE)]
        if not places:
            return None
        mean = sum(chosen) / len(chosen) if chosen else places[0]
        chosen.append(min(places, key=lambda x: abs(x - mean)))
    return sum(chosen) / len(chosen) if chosen and max(chosen) - min(chosen) <= 8 else None


@F.pandas_udf(ArrayType(IntegerType()))
def columns_of(names: pd.Series, header: pd.Series) -> pd.Series:
    return pd.Series([column_order(list(n), list(h)) for n, h in zip(names, header)])


def _personality_groups(lines: DataFrame) -> DataFrame:
    """Lines with the context and group heading that they stand under (``_group``: its line), of documents with two
    contexts or more."""
    text, w = F.col("text"), in_document()
    s = lines.withColumn("_ctx", F.when(text.rlike(CONTEXT), F.regexp_replace(F.lower(F.trim("text")), r"\s*-\s*", " - ")))
    s = s.withColumn("_several", F.count("_ctx").over(W.partitionBy("doc_id"))).where("_several >= 2")
    s = s.withColumn("_in", F.last("_ctx", ignorenulls=True).over(w)).withColumn("_start", F.when(F.col("_ctx").isNotNull(), -1).when(text.rlike(GROUP), F.col("line_no")))
    return s.withColumn("_group", F.last("_start", ignorenulls=True).over(w)).where("_group > 0 and _in is not null")


def contextual_personalities(lines: DataFrame) -> DataFrame:
    """Named personalities with sizes under a context heading, printed in parallel: group_line, context, personality (its
    number in the group), name, size and column, which the places of the names in the header lines decide."""
    p = _parallel(lines).select("doc_id", "group_line", "context", F.posexplode("personalities").alias("personality", "p"))
    return p.select("doc_id", "group_line", "context", "personality", "p.name", "p.size", "p.column")


def _parallel(lines: DataFrame) -> DataFrame:
    """A row for each group: doc_id, group_line, context and its personalities in the order listed (name, size, column)."""
    shown = F.create_map(*[F.lit(x) for kv in CONTEXTS.items() for x in kv])
    s = _personality_groups(lines)
    below = W.partitionBy("doc_id", "_group").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.when(F.col("line_no") > F.col("_group"), F.length("text") + 1)).over(below), F.lit(0)) + 1
    s = s.withColumn("_at", at).withColumn("_k", F.count(F.when((F.col("line_no") > F.col("_group")) & (F.col("text") != ""), 1)).over(W.partitionBy("doc_id", "_group").orderBy("line_no")))
    seen = F.when((F.col("line_no") > F.col("_group")) & (F.col("text") != "") & (F.col("_k") <= HEADER_LINES) & (F.col("_at") < HEADER_CHARS), F.struct("line_no", F.substring("text", F.lit(1), (HEADER_CHARS - F.col("_at")).cast("int")).alias("t")))
    g = s.groupBy("doc_id", "_group", "_in").agg(F.max(F.when(F.col("line_no") == F.col("_group"), F.col("text"))).alias("h"), F.array_sort(F.collect_list(seen)).alias("seen"))
    one = lambda i: F.regexp_extract_all(F.regexp_extract("h", GROUP, 1), F.lit(PERSONALITY), F.lit(i))
    g = g.withColumn("names", F.transform(one(1), lambda n: F.trim(n))).withColumn("sizes", F.transform(one(2), lambda n: n.cast("int")))
    g = g.withColumn("columns", columns_of("names", F.transform("seen", lambda x: x["t"])))
    each = F.transform(F.arrays_zip("names", "sizes", "columns"), lambda p: F.struct(F.initcap(p["names"]).alias("name"), p["sizes"].alias("size"), p["columns"].alias("column")))
    return g.select("doc_id", F.col("_group").alias("group_line"), shown[F.col("_in")].alias("context"), each.alias("personalities"))


def personality_rows(lines: DataFrame) -> DataFrame:
    """Rows of parallel tables: each leading cell is a position of the personality of its column; the first line of a
    position wins."""
    cells = rf"^((?:(?:[0-9]{{1,3}}|-)\s+)+){RANGE}\s+(.*)$"
    hit = _personality_groups(lines).where(F.col("text").rlike(cells)).select("doc_id", F.col("_group").alias("group_line"), "line_no", F.split(F.trim(F.regexp_extract("text", cells, 1)), r"\s+").alias("cells"), F.regexp_extract("text", cells, 4).alias("label"))
    long = hit.join(_parallel(lines), ["doc_id", "group_line"]).where("size(cells) = size(personalities)")
    long = long.select("doc_id", "group_line", "context", "line_no", "label", "cells", F.posexplode("personalities").alias("personality", "p"))
    placed = long.select("doc_id", "group_line", "context", "personality", F.col("p.name").alias("name"), F.col("p.size").alias("size"), "line_no", "label", F.get("cells", F.col("p.column")).alias("cell")).where("cell <> '-'")
    placed = placed.withColumn("position", F.col("cell").try_cast("int")).where("position between 1 and size")
    first = W.partitionBy("doc_id", "group_line", "personality", "position").orderBy("line_no")
    return placed.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("doc_id", "context", "name", "position", "line_no", "label")


def choose_grammar(tables: DataFrame) -> DataFrame:
    """Tables of the first grammar that gave any for the document."""
    order = F.create_map(*[F.lit(x) for k, v in GRAMMARS.items() for x in (k, v)])
    t = tables.withColumn("_p", order[F.col("grammar")])
    return t.withColumn("_r", F.rank().over(W.partitionBy("doc_id").orderBy("_p"))).where("_r = 1").drop("_p", "_r")


# What a manual with a channel table says somewhere.
HAS_TABLE = r"(?i)(channel value table|dmx channel assignments(?: and values)?|dmx charts?|dmx traits|dmx channels?\s*[:\-]?\s*[0-9])"


def channel_counts(lines: DataFrame, structured: DataFrame, declared: DataFrame, components: DataFrame) -> DataFrame:
    """Whether the text has the words of a channel table, and the count: most structured, else most declared, else of a text
    with such words the number of its known components, else 0."""
    flat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    v = lines.groupBy("doc_id").agg(F.regexp_replace(flat, r"\s+", " ").rlike(HAS_TABLE).alias("has_vocabulary"))
    s = structured.groupBy("doc_id").agg(F.max("table_count").alias("s"))
    d = declared.groupBy("doc_id").agg(F.max("size").alias("d"))
    k = components.groupBy("doc_id").agg(F.count("*").cast("int").alias("k"))
    j = v.join(s, "doc_id", "left").join(d, "doc_id", "left").join(k, "doc_id", "left")
    return j.select("doc_id", "has_vocabulary", F.coalesce("s", "d", F.when(F.col("has_vocabulary"), F.col("k")), F.lit(0)).alias("channel_count"))


def reject_thin_tables(modes: DataFrame) -> DataFrame:
    """A document's table goes if its widest mode was read to less than half its size."""
    widest = modes.groupBy("doc_id").agg(F.max(F.struct("size", "parsed")).alias("w"))
    return modes.join(widest.where("w.parsed * 2 >= w.size").select("doc_id"), "doc_id", "left_semi")
