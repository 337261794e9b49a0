"""Catalogs mined from the truth database: brands, and names to attributes by majority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmine.functions.text import attribute_key, attribute_template, brand_key


def brand_counts(makers: DataFrame) -> DataFrame:
    return makers.groupBy("maker").agg(F.count("*").alias("n"))


def build_brand_catalog(counts: DataFrame, deny: DataFrame, strong: DataFrame) -> DataFrame:
    """Per key the spelling of most rows (ties by name); the others are aliases; denied and short
    names go; strong-signal flag. deny(key), strong(key)."""
    c = counts.select(F.trim("maker").alias("name"), "n").where("name is not null and length(name) >= 3")
    c = c.groupBy("name").agg(F.sum("n").alias("n")).withColumn("key", brand_key(F.col("name"))).join(deny, "key", "left_anti")
    w = W.partitionBy("key").orderBy(F.desc("n"), "name")
    r = c.withColumn("_r", F.row_number().over(w))
    g = r.groupBy("key").agg(F.max(F.when(F.col("_r") == 1, F.col("name"))).alias("canonical"), F.sort_array(F.collect_set(F.when(F.col("_r") > 1, F.col("name")))).alias("aliases"))
    return g.join(strong.select("key", F.lit(True).alias("s")), "key", "left").select("canonical", "aliases", F.coalesce("s", F.lit(False)).alias("requires_strong_signal")).orderBy(F.lower("canonical"), "canonical")


def attribute_votes(channels: DataFrame, modes: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Rows by channel name, attribute and source."""
    j = channels.where("pretty is not null and attribute is not null").join(modes, "mode_id").join(fixtures.select("fixture_id", "source"), "fixture_id")
    return j.groupBy("pretty", "attribute", "source").agg(F.count("*").alias("n"))


def vote_pool(votes: DataFrame, preferred: str = "library", enough: int = 20, floor: int = 300, least: int = 50) -> DataFrame:
    """Votes by key and template: those of the preferred source where they are enough, else all of
    them if they reach the floor; a pool below ``least`` is none."""
    v = votes.withColumn("key", attribute_key(F.col("pretty"))).withColumn("template", attribute_template(F.col("attribute"))).where("length(key) >= 2 and template is not null")
    w = W.partitionBy("key")
    v = v.withColumn("_own", F.sum(F.when(F.col("source") == preferred, F.col("n")).otherwise(0)).over(w)).withColumn("_all", F.sum("n").over(w))
    use = v.where(((F.col("_own") >= enough) & (F.col("source") == preferred)) | ((F.col("_own") < enough) & (F.col("_all") >= floor)))
    p = use.groupBy("key", "template").agg(F.sum("n").alias("n"))
    return p.withColumn("total", F.sum("n").over(w)).where(F.col("total") >= least)


def majority_template(pool: DataFrame, ratio: float = 0.85) -> DataFrame:
    """The template of most votes (ties to the greatest), unless it says there is no feature or
    has too small a share."""
    w = W.partitionBy("key").orderBy(F.desc("n"), F.desc("template"))
    top = pool.withColumn("_r", F.row_number().over(w)).where("_r = 1 and template <> 'NoFeature'")
    return top.where(F.col("n") / F.col("total") >= ratio).select("key", "template", "total", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


def digit_template(c):
    """Digits as (n), then (m): the form in which a taxonomy names zoned attributes."""
    return F.regexp_replace(F.regexp_replace(c, "^([^0-9]*)[0-9]+", "$1(n)"), r"^([^0-9]*\(n\)[^0-9]*)[0-9]+", "$1(m)")


def match_taxonomy(attributes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The first taxonomy entry (by ord) whose name is the attribute's template."""
    t = attributes.select("attribute").distinct().withColumn("_t", digit_template(F.col("attribute")))
    j = t.join(taxonomy, F.col("_t") == F.col("name"), "left")
    w = W.partitionBy("attribute").orderBy("ord")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("attribute", "name", "feature")


def validate_templates(mapped: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return mapped.join(taxonomy.select(F.col("name").alias("template")), "template", "left_semi")


def lookup_attribute(names: DataFrame, attribute_map: DataFrame) -> DataFrame:
    """A name's attribute from the map, its zone number (default 1) put back without zeros."""
    n = names.withColumn("key", attribute_key(F.col("name")))
    zone = F.coalesce(F.regexp_extract("name", "([0-9]+)", 1).try_cast("int"), F.lit(1)).cast("string")
    return n.join(attribute_map.select("key", "template"), "key", "left").select(*names.columns, F.replace(F.col("template"), F.lit("(n)"), zone).alias("attribute"))
