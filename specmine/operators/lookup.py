"""Fuzzy lookup of makers and models in an outside listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmine.functions.text import clean_text, normalize_name, text_score


def clean_footprints(c: Column) -> Column:
    """Whole numbers from 1 to 65535, distinct in order, the first 64 (a limit of the interface)."""
    return F.slice(F.array_distinct(F.filter(c, lambda x: x.between(1, 65535))), 1, 64)


def nested_footprints(listing: DataFrame, key: str = "dmxfootprint", depth: int = 5, most: int = 64) -> DataFrame:
    """Values under a key (any case) at any depth up to five of a variant column ``modes``; of a
    listing's distinct values the first ``most`` in order (a limit of the interface)."""
    levels = []
    for n in range(1, depth + 1):
        joins = "".join(f", lateral variant_explode_outer(v{i - 1}.value) v{i}" for i in range(2, n + 1))
        levels.append(listing.sparkSession.sql(f"select rid, try_cast(v{n}.value as int) as footprint, v{n}.key as k from {{listing}}, lateral variant_explode_outer(modes) v1{joins}", listing=listing))
    found = reduce(DataFrame.unionAll, levels).where((F.lower("k") == key) & F.col("footprint").isNotNull())
    w = W.partitionBy("rid").orderBy("footprint")
    return found.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= most).select("rid", "footprint")


def name_pairs(left: DataFrame, right: DataFrame, least: float = 0.55) -> DataFrame:
    """(x, y, score) of all names x of ``left`` and y of ``right`` with a score of ``least`` or more.

    Names that score by shared words share one among the rarest of each (of n words all but
    least * n, and one more); of names that hold one another, the longer has the rarest four characters
    of the shorter. So pairs meet by rare keys, and common words join nothing.
    """
    names = left.select(F.col("x").alias("name")).unionByName(right.select(F.col("y").alias("name"))).where("name <> ''").distinct()
    words = F.array_distinct(F.split("name", " "))
    grams = F.when(F.length("name") >= 4, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 3), lambda i: F.substring("name", i, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    units = names.select("name", F.explode(F.concat(F.transform(words, lambda u: F.struct(F.lit("w").alias("kind"), u.alias("u"))), F.transform(grams, lambda u: F.struct(F.lit("g").alias("kind"), u.alias("u"))))).alias("k")).select("name", "k.kind", "k.u")
    often = units.groupBy("kind", "u").agg(F.count("*").alias("n"))
    of = lambda kind: F.array_sort(F.filter(F.collect_list(F.struct("kind", "n", "u")), lambda k: k["kind"] == kind))
    ranked = units.join(often, ["kind", "u"]).groupBy("name").agg(of("w").alias("w"), of("g").alias("g"))
    few = F.slice("w", F.lit(1), (F.size("w") - F.ceil(F.size("w") * least) + 1).cast("int"))
    keys = lambda c, kind: F.transform(c, lambda k: F.struct(F.lit(kind).alias("kind"), k["u"].alias("u")))
    one, every = F.slice("g", 1, 1), F.col("g")
    x = ranked.join(left.select(F.col("x").alias("name")), "name").select(F.col("name").alias("x"), F.explode(F.concat(keys(few, "w"), keys(one, "in"), keys(every, "holds"))).alias("k"))
    y = ranked.join(right.select(F.col("y").alias("name")), "name").select(F.col("name").alias("y"), F.explode(F.concat(keys(few, "w"), keys(every, "in"), keys(one, "holds"))).alias("k"))
    return x.join(y, "k").select("x", "y").distinct().withColumn("score", text_score(F.col("x"), F.col("y"))).where(F.col("score") >= least)


def normal_names(queries: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = queries.select("query_id", normalize_name(F.col("manufacturer")).alias("qm"), normalize_name(F.col("model")).alias("qf"), F.col("footprints").alias("asked"))
    return q, listing.select("rid", normalize_name(F.col("manufacturer")).alias("rm"), normalize_name(F.col("fixture")).alias("rf"), "rating", "footprints")


def named_pairs(q: DataFrame, r: DataFrame, least: float) -> DataFrame:
    """(qm, qf, rm, rf, names): distinct maker and model on both sides that can reach ``least`` with a footprint's share."""
    pairs = lambda a, b, names: name_pairs(q.select(F.col(a).alias("x")).distinct(), r.select(F.col(b).alias("y")).distinct()).toDF(a, b, names)
    asked, listed = q.select("qm", "qf").distinct(), r.select("rm", "rf").distinct()
    # the few maker pairs first, then models by all three names, so that no model meets listings of other makers
    j = asked.join(pairs("qm", "rm", "maker_score"), "qm").join(pairs("qf", "rf", "model_score"), "qf")
    j = j.where(0.35 * F.col("maker_score") + 0.6 * F.col("model_score") + 0.05 >= least - 1e-9)
    return j.join(listed, ["rm", "rf"])


def with_score(j: DataFrame, least: float) -> DataFrame:
    print_score = F.when(F.size("asked") == 0, 0.5).when(F.arrays_overlap("asked", "footprints"), 1.0).otherwise(0.0)
    return j.withColumn("score", 0.35 * F.col("maker_score") + 0.6 * F.col("model_score") + 0.05 * print_score).where(F.col("score") >= least)


def match_listing(queries: DataFrame, listing: DataFrame, least: float = 0.72) -> DataFrame:
    """Maker and model scores of 0.55 or more, weighed .35 and .6; .05 if a footprint asked for is
    there, half of that if none is asked for. Both tables have an array ``footprints``. Names are matched
    once each; only the pairs of rows that come out are made."""
    q, r = normal_names(queries, listing)
    j = q.join(named_pairs(q, r, least), ["qm", "qf"]).join(r, ["rm", "rf"])
    return with_score(j, least).select("query_id", "rid", "score", "rating")


def rated(ident: str) -> list[Column]:
    return [F.desc(F.coalesce(F.col("rating").cast("double"), F.lit(0.0))), F.col(ident)]


def top_matches(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best by score, then rating (null as 0), then id."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *rated("rid"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_matches(queries: DataFrame, listing: DataFrame, k: int = 5, least: float = 0.72) -> DataFrame:
    """``top_matches`` of ``match_listing`` without all of its rows: listings of the same names and footprints score
    alike, so the k best rated of them stand for all, and queries that ask the same are answered once."""
    q, r = normal_names(queries, listing)
    alike = W.partitionBy("rm", "rf", "footprints").orderBy(*rated("rid"))
    few = r.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k).drop("_r")
    j = q.select("qm", "qf", "asked").distinct().join(named_pairs(q, few, least), ["qm", "qf"]).join(few, ["rm", "rf"])
    w = W.partitionBy("qm", "qf", "asked").orderBy(F.desc(F.round("score", 9)), *rated("rid"))
    best = with_score(j, least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(F.col("qm").alias("_qm"), F.col("qf").alias("_qf"), F.col("asked").alias("_asked"), "rid", "score", "rating")
    same = (F.col("qm") == F.col("_qm")) & (F.col("qf") == F.col("_qf")) & F.col("asked").eqNullSafe(F.col("_asked"))
    return top_matches(q.join(best, same).select("query_id", "rid", "score", "rating"), k)


def sanitize_matches(rows: DataFrame, hosts: list[str], home: str = "") -> DataFrame:
    """Matches that may be shown: maker, fixture and an https URL of an allowed host are required (a missing URL is ``home``). User
    info and fragment of the URL go, texts are cleaned and cut, any source but "manufacturer" is "community", scores are
    clamped to 0 to 1 and ratings to 0 to 5 (null where no number). Columns: id, manufacturer, fixture, source, url, rating, score."""
    url = F.coalesce(F.nullif("url", F.lit("")), F.lit(home))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    clean = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "(?i)^https://[^/@?]*@", "https://")
    clean = F.when(clean.rlike("(?i)^https://[^/?]+$"), F.concat(clean, F.lit("/"))).otherwise(clean)
    allowed = F.lower(url).startswith("https://") & host.isin(*[h.lower() for h in hosts])
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    clamp = lambda c, a, b: F.when(c.isNotNull(), F.least(F.lit(b), F.greatest(F.lit(a), c)))
    rating = F.when(F.abs(number("rating")) != float("inf"), number("rating"))
    s = rows.select(clean_text(F.col("id").cast("string"), 80).alias("id"), clean_text(F.col("manufacturer"), 96).alias("manufacturer"), clean_text(F.col("fixture"), 128).alias("fixture"), F.when(F.col("source") == "manufacturer", "manufacturer").otherwise("community").alias("source"), F.when(allowed, clean).alias("url"), clamp(rating, 0.0, 5.0).alias("rating"), clamp(number("score"), 0.0, 1.0).alias("score"))
    return s.where("manufacturer <> '' and fixture <> '' and url is not null")


def lookup_eligible(fixtures: DataFrame, footprints: DataFrame) -> DataFrame:
    """Records whose identity was read from the manual, with both names known; maker, model and distinct footprints as
    the query. fixtures: doc_id, manufacturer, model, from_manual."""
    known = lambda c: (F.trim(c) != "") & ~F.lower(F.trim(c)).startswith("unknown")
    f = footprints.where("footprint > 0").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("footprint")), " ").alias("footprints"))
    named = fixtures.where(F.col("from_manual") & known("manufacturer") & known("model"))
    return named.join(f, "doc_id", "left").select("doc_id", "manufacturer", "model", F.coalesce("footprints", F.lit("")).alias("footprints"))


def changed_lookups(history: DataFrame) -> DataFrame:
    """Rows whose key differs from the one before for their document, or that are forced."""
    w = W.partitionBy("doc_id").orderBy("ts", "event_id")
    return history.withColumn("_p", F.lag("key").over(w)).where("forced or not key <=> _p").drop("_p")


def newest_results(history: DataFrame) -> DataFrame:
    return history.groupBy("doc_id").agg(F.max_by("key", F.struct("ts", "event_id")).alias("key"))
