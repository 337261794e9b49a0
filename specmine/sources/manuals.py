"""Manual text: files, pages, lines and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmine.sources.files import whole_texts

MARKER = r"=== PAGE ([0-9]+) ==="


def read_manual_text(spark: SparkSession, folder: str) -> DataFrame:
    """One document a .txt file: doc_id, source_name (base name + .pdf), text."""
    base = F.regexp_replace("file", r"\.txt$", "")
    return whole_texts(spark, folder, "*.txt").select(base.alias("doc_id"), F.concat(base, F.lit(".pdf")).alias("source_name"), F.col("value").alias("text"))


def split_pages(docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """Pages by marker lines; text ahead of the first marker is page 0."""
    parts = F.split("text", rf"(?m)^{marker}\r?\n?")
    numbers = F.regexp_extract_all("text", F.lit(rf"(?m)^{marker}"), F.lit(1))
    page = F.when(F.col("pos") == 0, 0).otherwise(F.get("numbers", F.col("pos") - 1).cast("int"))
    out = docs.withColumn("numbers", numbers).select("*", F.posexplode(parts).alias("pos", "part"))
    return out.select("doc_id", page.alias("page"), F.regexp_replace("part", r"\r?\n$", "").alias("text")).where("page > 0 or text <> ''")


def split_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages; ``line_no`` runs over the document. LF, CRLF and CR end lines."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "text"))
    per_page = lines.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per_page.select("doc_id", "page", before.alias("before"))
    return lines.join(starts, ["doc_id", "page"]).select("doc_id", "page", (F.col("before") + F.col("pos") + 1).cast("int").alias("line_no"), "text")


def joined(items: Column, separator: str) -> Column:
    """Texts of (order, text) structs in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), separator)


def pages_of_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "page").agg(joined(F.collect_list(F.struct("line_no", "text")), "\n").alias("text"))


def assemble_text(pages: DataFrame) -> DataFrame:
    """One marked string for each document, pages in order."""
    marked = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), F.col("text"))
    return pages.select("doc_id", "page", marked.alias("text")).groupBy("doc_id").agg(joined(F.collect_list(F.struct("page", "text")), "\n").alias("text"))


def append_region_text(docs: DataFrame, regions: DataFrame, heading: str = "Region table") -> DataFrame:
    """A re-read region goes under a heading of its own at the end."""
    r = regions.select("doc_id", F.concat(F.lit(f"\n{heading}\n"), F.col("region_text")).alias("_more"))
    return docs.join(r, "doc_id", "left").withColumn("text", F.concat(F.col("text"), F.coalesce("_more", F.lit("")))).drop("_more")
