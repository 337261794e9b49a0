"""Which pages are read again, which reading wins, and what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of table headings, rows and vocabulary.
RANGES = r"[0-9]{1,3} ?[-–—] ?[0-9]{1,3}"
HEADINGS = r"(?i)\b(channel table|channel mode|dmx (chart|channels|values|mode)|function)\b"
VOCABULARY = r"(?i)\b(dmx|channel|function|value)"
VALUE_ROW = r"(?m)^ *[0-9]{1,3} +.*[0-9]{1,3} ?[-–—] ?[0-9]{1,3}"


def pages_needing_ocr(pages: DataFrame) -> DataFrame:
    return pages.where(F.length("text") < 80)


def page_table_stats(pages: DataFrame, *keep: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return pages.select("doc_id", "page", count(RANGES).alias("n_ranges"), F.col("text").rlike(VOCABULARY).alias("has_vocabulary"), count(HEADINGS).alias("n_headings"), *keep)


def pages_for_detailed_read(pages: DataFrame) -> DataFrame:
    """Pages with 1 to 3 headings but no readable table, and the page after under the same test;
    and pages read by OCR with 5 ranges or more. ``pages`` has from_ocr."""
    s = page_table_stats(pages, "from_ocr").withColumn("_unreadable", F.col("from_ocr") | (F.col("n_ranges") < 5))
    s = s.withColumn("_head", F.coalesce(F.col("n_headings").between(1, 3) & F.col("_unreadable"), F.lit(False)))
    before = W.partitionBy("doc_id").orderBy("page").rangeBetween(-1, -1)
    s = s.withColumn("_follows", F.coalesce(F.max("_head").over(before), F.lit(False)))
    return s.where("_head or (doc_id is not null and _follows and _unreadable) or (from_ocr and n_ranges >= 5)").select("doc_id", "page").distinct()


def table_text_score(pages: DataFrame) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p))
    score = F.when(F.col("text").rlike(HEADINGS), 500.0).otherwise(0.0) + 25 * count(VALUE_ROW) + 8 * count(RANGES) + F.least(F.length("text"), F.lit(12000)) / 100
    return pages.withColumn("score", score.cast("double"))


def merge_readings(broad: DataFrame, detailed: DataFrame) -> DataFrame:
    """The detailed reading stands ahead of the broad one if it scores 0.7 of it or more."""
    b = table_text_score(broad).select("doc_id", "page", F.col("text").alias("b"), F.col("score").alias("sb"))
    d = table_text_score(detailed).select("doc_id", "page", F.col("text").alias("d"), F.col("score").alias("sd"))
    text = F.when(F.col("sd") >= F.col("sb") * 0.7, F.concat_ws("\n", "d", "b")).otherwise(F.col("b"))
    return b.join(d, ["doc_id", "page"], "left").select("doc_id", "page", text.alias("text"))


def rank_readings(words: DataFrame) -> DataFrame:
    """The best rotation of each page by mean confidence times the root of the words; the upright
    fast path and close calls are marked."""
    s = words.groupBy("doc_id", "page", "rotation").agg(F.count("*").alias("n_words"), F.avg("confidence").alias("mean_confidence"))
    s = s.withColumn("score", F.col("mean_confidence") * F.sqrt("n_words"))
    w = W.partitionBy("doc_id", "page").orderBy(F.desc("score"), "rotation")
    s = s.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    upright = (F.col("rotation") == 0) & (F.col("n_words") >= 20) & (F.col("mean_confidence") >= 58)
    return s.where("rank = 1").select("doc_id", "page", "rotation", "score", upright.alias("upright"), F.coalesce(F.col("second") > F.col("score") * 0.75, F.lit(False)).alias("close_call"))


def combine_readings(words: DataFrame) -> DataFrame:
    """All readings of a page as one text, the higher summed confidence first."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "text"))), lambda s: s["text"]), " ")
    r = words.groupBy("doc_id", "page", "rotation").agg(text.alias("text"), F.sum("confidence").cast("long").alias("c"))
    both = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "rotation", "text")))
    return r.groupBy("doc_id", "page").agg(F.array_join(F.transform(both, lambda s: s["text"]), "\n").alias("text"))


def failed_pages(log: DataFrame) -> DataFrame:
    """Pages whose latest read failed; reads without a page say nothing."""
    return log.where("page is not null").groupBy("doc_id", "page").agg(F.max_by("ok", F.struct("attempt", "event_id")).alias("ok")).where("not ok").select("doc_id", "page")


def page_runs(failed: DataFrame) -> DataFrame:
    """Consecutive pages as ranges: "1, 3 and 7-21"."""
    w = W.partitionBy("doc_id").orderBy("page")
    runs = failed.withColumn("_g", F.col("page") - F.row_number().over(w)).groupBy("doc_id", "_g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    l = runs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda s: s["t"]).alias("l"))  # noqa: E741
    more = F.concat(F.array_join(F.slice("l", 1, F.size("l") - 1), ", "), F.lit(" and "), F.element_at("l", -1))
    return l.select("doc_id", F.when(F.size("l") == 1, F.get("l", F.lit(0))).otherwise(more).alias("pages"))


def dedupe_page_readings(lines: DataFrame) -> DataFrame:
    """Of several copies of a page's table the one with most value rows, the later on ties."""
    counts = lines.groupBy("doc_id", "page", "copy").agg(F.count_if(F.col("text").rlike(RANGES)).alias("n"))
    w = W.partitionBy("doc_id", "page").orderBy(F.desc("n"), F.desc("copy"))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", "page", "copy", "n")
