"""Layout: positioned words to visual rows, row text, column headers and cells.

A word joins the topmost row whose first word is within its tolerance, else it starts a row: one
fold over a page's words in order. A page is one row of the table there, never several pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def _clusters(items: DataFrame, down: Column, tolerance: Column) -> DataFrame:
    """row_id from the top; ``down`` is how far down a word stands."""
    names = items.columns
    kept = items.where(F.trim("text") != "").select(*PAGE, F.struct(down.alias("k"), "x", "item_no", tolerance.alias("tol"), F.struct(*names).alias("row")).alias("w"))
    pages = kept.groupBy(*PAGE).agg(F.array_sort(F.collect_list("w")).alias("w"))
    start = F.struct(F.array().cast("array<double>").alias("rows"), F.array().cast("array<int>").alias("ids"))

    def step(s: Column, w: Column) -> Column:
        at = F.array_position(F.transform(s["rows"], lambda y: F.abs(y - w["k"]) <= w["tol"]), True).cast("int")
        new = at == 0
        return F.struct(F.when(new, F.concat(s["rows"], F.array(w["k"]))).otherwise(s["rows"]).alias("rows"), F.concat(s["ids"], F.array(F.when(new, F.size(s["rows"]) + 1).otherwise(at))).alias("ids"))

    slim = F.transform("w", lambda w: F.struct(w["k"].alias("k"), w["tol"].alias("tol")))
    each = pages.select(*PAGE, "w", F.aggregate(slim, start, step)["ids"].alias("ids")).select(F.explode(F.arrays_zip("w", "ids")).alias("z"))
    return each.select("z.w.row.*", F.col("z.ids").alias("row_id"))


def cluster_rows(items: DataFrame) -> DataFrame:
    """Text items, y upwards; tolerance 0.38 of the height, from 2 to 5."""
    return _clusters(items, -F.col("y"), F.least(F.lit(5.0), F.greatest(F.lit(2.0), F.col("height") * 0.38)))


def cluster_ocr_rows(words: DataFrame) -> DataFrame:
    """OCR words by vertical centre, y downwards; tolerance 0.55 of the height, from 4 to 12."""
    return _clusters(words, F.col("y") + F.col("height") / 2, F.least(F.lit(12.0), F.greatest(F.lit(4.0), F.col("height") * 0.55)))


def _row_text(rows: DataFrame, separator: Column) -> DataFrame:
    w = W.partitionBy(*PAGE, "row_id").orderBy("x", "item_no")
    edge = F.max(F.col("x") + F.col("width")).over(w.rowsBetween(W.unboundedPreceding, -1))
    before = F.lag("text").over(w)
    parts = rows.withColumn("_gap", F.col("x") - edge).withColumn("_before", before)
    parts = parts.withColumn("_part", F.concat(F.when(F.col("_gap").isNull(), "").otherwise(separator), F.trim("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item_no", "_part"))), lambda s: s["_part"]), "")
    return parts.groupBy(*PAGE, "row_id").agg(text.alias("text"))


def join_row_text(rows: DataFrame) -> DataFrame:
    """Gaps over 18 are columns (three spaces); letters that touch are one word."""
    touching = (F.col("_gap") < F.col("height") * 0.15) & F.col("text").rlike("^[A-Za-z]") & F.col("_before").rlike("[A-Za-z]$")
    return _row_text(rows, F.when(F.col("_gap") > 18, "   ").when(touching, "").otherwise(" "))


def join_ocr_row_text(rows: DataFrame) -> DataFrame:
    """Gaps over 24 and twice the height are columns."""
    return _row_text(rows, F.when(F.col("_gap") > F.greatest(F.lit(24.0), F.col("height") * 2), "   ").otherwise(" "))


def _with_headers(rows: DataFrame) -> DataFrame:
    """A line for each row: ``header`` (counts and centres) if it is one, and its ``words`` in order. Words of a row are
    gathered once; labels are read only in rows where at least two words can belong to one."""
    unit = "(?i)^ch(annels?)?$"
    label = F.col("text").rlike("(?i)^([0-9]{1,3} ?)?ch(annels?)?$")
    got = rows.groupBy(*PAGE, "row_id").agg(F.sort_array(F.collect_list(F.struct("x", "item_no", "text", "width"))).alias("words"), F.count_if(label).alias("_labels"))

    def read(t: Column, i: Column) -> Column:
        after = F.get("words", i + 1)
        glued = F.regexp_extract(t["text"], "(?i)^([0-9]{1,3}) ?ch(?:annels?)?$", 1).try_cast("int")
        right = F.when(glued.isNotNull(), t["x"] + t["width"]).otherwise(after["x"] + after["width"])
        n = F.coalesce(glued, F.when(after["text"].rlike(unit), t["text"].try_cast("int")))
        return F.struct(((t["x"] + right) / 2).alias("centre"), n.alias("n"), t["text"].rlike("(?i)^[^0-9]+ch$|^[?#]+ ?ch").alias("odd"))

    some = got.withColumn("_read", F.when(F.col("_labels") >= 2, F.transform("words", read)))
    some = some.withColumn("s", F.when(~F.exists("_read", lambda t: F.coalesce(t["odd"], F.lit(False)) & t["n"].isNull()), F.array_sort(F.filter("_read", lambda t: t["n"].isNotNull()))))
    counts = F.transform("s", lambda t: t["n"])
    header = F.struct(counts.alias("counts"), F.transform("s", lambda t: t["centre"]).alias("centres"))
    return some.select(*PAGE, "row_id", F.when((F.size("s") >= 2) & (F.size("s") == F.size(F.array_distinct(counts))), header).alias("header"), "words")


def detect_count_headers(rows: DataFrame) -> DataFrame:
    """Rows that name two or more distinct column sizes; a label whose size can't be read voids
    the row. Columns: page, row_id, counts and centres in order."""
    return _with_headers(rows).where("header is not null").select(*PAGE, "row_id", "header.counts", "header.centres")


def detect_stacked_headers(rows: DataFrame) -> DataFrame:
    """Sizes on one row and units one or two rows below, each within a quarter of the pitch."""
    w = W.partitionBy(*PAGE, "row_id").orderBy("x", "item_no")
    n = rows.withColumn("k", F.row_number().over(w)).withColumn("centre", F.col("x") + F.col("width") / 2)
    sizes = n.where(F.col("text").rlike("^[0-9]{1,3}$"))
    units = n.where(F.col("text").rlike("(?i)^ch(annels?)?$")).select(*PAGE, F.col("row_id").alias("unit_row"), F.col("k").alias("uk"), F.col("centre").alias("uc"))
    pitch = sizes.withColumn("_d", F.col("centre") - F.lag("centre").over(w)).groupBy(*PAGE, "row_id").agg(F.min("_d").alias("pitch"), F.count("*").alias("n_sizes"))
    pairs = sizes.join(units, PAGE).where("unit_row between row_id + 1 and row_id + 2 and uk = k").join(pitch, [*PAGE, "row_id"])
    fit = pairs.groupBy(*PAGE, "row_id", "unit_row", "n_sizes").agg(F.bool_and(F.abs(F.col("uc") - F.col("centre")) <= F.col("pitch") * 0.25).alias("good"), F.count("*").alias("c"), F.transform(F.array_sort(F.collect_list(F.struct("centre", F.col("text").cast("int").alias("n")))), lambda s: s["n"]).alias("counts"))
    return fit.where("good and c = n_sizes and c >= 2").select(*PAGE, "row_id", "counts")


def column_pitch(headers: DataFrame) -> DataFrame:
    """Least gap of neighbouring centres and the table's span, half a pitch beyond the outer ones."""
    gaps = F.zip_with(F.slice("centres", 2, 1000), F.slice("centres", F.lit(1), F.greatest(F.size("centres") - 1, F.lit(0))), lambda b, a: b - a)
    h = headers.withColumn("pitch", F.array_min(gaps))
    return h.withColumn("left_edge", F.element_at("centres", 1) - F.col("pitch") / 2).withColumn("right_edge", F.element_at("centres", -1) + F.col("pitch") / 2)


def active_header(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Each row with the latest header row at or above it on its page."""
    ids = rows.select(*PAGE, "row_id").distinct()
    h = headers.select(*PAGE, "row_id", F.col("row_id").alias("_h"))
    w = W.partitionBy(*PAGE).orderBy("row_id").rowsBetween(W.unboundedPreceding, 0)
    return ids.join(h, [*PAGE, "row_id"], "left").withColumn("header_row", F.last("_h", ignorenulls=True).over(w)).drop("_h")


def value_column_edge(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Running right edge of range values since the last header."""
    is_value = F.col("text").rlike(r"^[0-9]{1,3} ?[-–—] ?[0-9]{1,3}$|^[0-9]{1,3}$")
    per_row = rows.groupBy(*PAGE, "row_id").agg(F.max(F.when(is_value, F.col("x") + F.col("width"))).alias("_e"))
    w = W.partitionBy(*PAGE, "header_row").orderBy("row_id").rowsBetween(W.unboundedPreceding, 0)
    return per_row.join(active, [*PAGE, "row_id"]).where("header_row is not null").select(*PAGE, "row_id", "header_row", F.max("_e").over(w).alias("value_edge"))


def snap_cells(rows: DataFrame) -> DataFrame:
    """Numbers under a header go to the nearest column within 0.4 of the pitch; a row is out if
    one misses or two meet. Blanks are dashes; rows without a blank say nothing new and go.

    Headers come down by a window, columns are found in the row.
    """
    w = W.partitionBy(*PAGE).orderBy("row_id").rowsBetween(W.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("header").isNotNull(), F.struct(F.col("row_id").alias("at"), F.col("header.centres").alias("centres"))), ignorenulls=True).over(w)
    h = _with_headers(rows).withColumn("h", latest).where("row_id > h.at")
    centres = F.col("h.centres")
    h = column_pitch(h.select(*PAGE, "row_id", F.col("h.at").alias("header_row"), "words", centres.alias("centres")))
    middle = lambda t: t["x"] + t["width"] / 2
    numbers = F.filter("words", lambda t: t["text"].rlike("^[0-9]{1,3}$") & middle(t).between(F.col("left_edge"), F.col("right_edge")))

    def nearest(t: Column) -> Column:
        far = F.array_min(F.transform("centres", lambda c, i: F.struct(F.abs(middle(t) - c).alias("far"), i.alias("col"))))
        return F.struct(far["col"].alias("col"), far["far"].alias("far"), t["text"].alias("text"))

    # exploded, so that the filter below isn't pushed ahead of m and doesn't find columns again for each use of it
    m = h.withColumn("m", F.explode(F.array(F.transform(numbers, nearest)))).withColumn("width", F.size("centres"))
    ok = F.forall("m", lambda s: s["far"] <= F.col("pitch") * 0.4) & (F.size("m") > 0) & (F.size("m") < F.col("width")) & (F.size(F.array_distinct(F.transform("m", lambda s: s["col"]))) == F.size("m"))
    text = lambda i: F.coalesce(F.get(F.transform(F.filter("m", lambda s: s["col"] == i), lambda s: s["text"]), F.lit(0)), F.lit("-"))
    return m.where(ok).select(*PAGE, "row_id", "header_row", F.transform(F.sequence(F.lit(0), F.col("width") - 1), text).alias("cells"))
