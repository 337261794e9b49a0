"""Evaluation: extraction against truth, slot by slot and mode by mode.

Multisets are joined as counts. Scoring gathers a manual's slots into one row of truth and
extracted modes, joined once by document; everything after stays in that partitioning. What a
row gathers is one manual's record, never rows of several documents.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

from specmine.functions.text import norm_name

MODE = ["doc_id", "mode_idx"]
FILENAME_ECHO = r"(?i)\bum$"  # fixed value: a model that ends like a file name's "user manual"


def truth_slots(modes: DataFrame, channels: DataFrame, functions: DataFrame) -> DataFrame:
    """Coarse and distinct fine offsets as slots of (break, offset); a later channel overwrites an
    earlier one, a fine byte its own coarse one. Names are pretty names, else attributes. Slots are dealt out
    by document once, for all that follows."""
    n = functions.groupBy("channel_id").agg(F.count("*").alias("n_functions"))
    c = channels.join(n, "channel_id", "left").join(modes.select("mode_id", F.col("fixture_id").alias("doc_id"), F.col("idx").alias("mode_idx")), "mode_id")
    c = c.select(*MODE, "channel_id", F.coalesce("dmx_break", F.lit(1)).alias("dmx_break"), F.coalesce("pretty", "attribute").alias("name"), "attribute", F.coalesce("n_functions", F.lit(0)).alias("n_functions"), "offset_coarse", "offset_fine")
    own = F.when(F.col("offset_coarse").isNotNull(), F.struct(F.col("offset_coarse").alias("slot"), F.col("n_functions"), F.lit(0).alias("fine")))
    below = F.when(F.expr("offset_fine is not null and not offset_fine <=> offset_coarse"), F.struct(F.col("offset_fine").alias("slot"), F.lit(0).cast("long").alias("n_functions"), F.lit(1).alias("fine")))
    both = c.select(*MODE, "channel_id", "dmx_break", "name", "attribute", F.explode(F.array(own, below)).alias("x")).where("x is not null")
    slots = both.select(*MODE, "channel_id", "dmx_break", "x.slot", "name", "attribute", "x.n_functions", "x.fine").repartition("doc_id")
    w = W.partitionBy(*MODE, "dmx_break", "slot").orderBy(F.desc("channel_id"), F.desc("fine"))
    return slots.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "channel_id")


def extract_slots(rows: DataFrame) -> DataFrame:
    """Assignments with an offset; the last of a slot wins."""
    w = W.partitionBy(*MODE, "dmx_break", "channel_offset").orderBy(F.desc("slot_idx"))
    r = rows.where("channel_offset is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return r.select(*MODE, "dmx_break", F.col("channel_offset").alias("slot"), "name", "attribute", "fine_of", "n_ranges")


def footprints(slots: DataFrame) -> DataFrame:
    return slots.groupBy(*MODE).agg(F.count_distinct("dmx_break", "slot").alias("footprint"))


def join_truth(extracts: DataFrame, manifest: DataFrame, fixtures: DataFrame) -> DataFrame:
    """extracts(file) to fixtures by the manifest's integer id, else its GUID."""
    m = extracts.join(manifest, "file")
    by_id = m.join(fixtures.select("fixture_id"), "fixture_id").select("file", "fixture_id")
    by_guid = m.where("fixture_id is null").drop("fixture_id").join(fixtures.select("fixture_id", F.upper("gdtf_guid").alias("guid")), "guid").select("file", "fixture_id")
    return by_id.unionByName(by_guid)


def unscored(extracts: DataFrame, manifest: DataFrame, joined: DataFrame) -> DataFrame:
    """Files without a manifest row, and files whose row has no truth."""
    none = extracts.join(manifest, "file", "left_anti").select("file", F.lit("no manifest row").alias("reason"))
    lost = extracts.join(manifest, "file", "left_semi").join(joined, "file", "left_anti").select("file", F.lit("no truth").alias("reason"))
    return none.unionByName(lost)


def footprint_recall_precision(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """Multiset intersection of footprints; recall is null only without truth modes, precision
    without extracted ones."""
    t = truth.groupBy("doc_id", "footprint").agg(F.count("*").alias("t"))
    e = extracted.groupBy("doc_id", "footprint").agg(F.count("*").alias("e"))
    j = t.join(e, ["doc_id", "footprint"], "full").na.fill(0, ["t", "e"])
    g = j.groupBy("doc_id").agg(F.sum(F.least("t", "e")).alias("hits"), F.sum("t").alias("n_truth"), F.sum("e").alias("n_extracted"))
    return g.select("doc_id", "n_truth", "n_extracted", F.try_divide("hits", "n_truth").alias("recall"), F.try_divide("hits", "n_extracted").alias("precision"))


def greedy_hits(t: str, e: str) -> Column:
    """How many of the sizes t find one of e, each once, that differs by one at most; both sorted."""
    start = F.struct(F.col(e).alias("pool"), F.lit(0).alias("n"))

    def step(s, x):
        fit = F.filter(s["pool"], lambda p: F.abs(p - x) <= 1)
        first = F.get(fit, F.lit(0))
        at = F.array_position(s["pool"], first)
        rest = F.concat(F.slice(s["pool"], F.lit(1), (at - 1).cast("int")), F.slice(s["pool"], (at + 1).cast("int"), F.size(s["pool"])))
        return F.when(F.size(fit) > 0, F.struct(rest.alias("pool"), (s["n"] + 1).alias("n"))).otherwise(s)

    return F.aggregate(t, start, step)["n"]


def recall_tol1(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """Greedy match of sorted sizes that differ by one at most, one document's sizes at a time."""
    t = truth.groupBy("doc_id").agg(F.sort_array(F.collect_list("footprint")).alias("t"))
    e = extracted.groupBy("doc_id").agg(F.sort_array(F.collect_list("footprint")).alias("e"))
    j = t.join(e, "doc_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<bigint>")))
    return j.select("doc_id", (greedy_hits("t", "e") / F.size("t")).alias("recall_tol1"))


@lru_cache(1 << 16)  # a pair of names comes again and again
def _ratio_of(a: str, b: str) -> float | None:
    if len(a) < 200 and len(b) < 200:  # longer ones have letters that difflib leaves out
        if a == b:
            return 1.0 if a else None
        if not a or not b:
            return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio() if a or b else None


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


def name_ratio(pairs: DataFrame) -> DataFrame:
    """Ratcliff/Obershelp ratio of normalised names (a, b), once for each distinct pair."""
    n = pairs.withColumn("_a", norm_name(F.col("a"))).withColumn("_b", norm_name(F.col("b")))
    d = n.select("_a", "_b").distinct().withColumn("name_ratio", _ratio("_a", "_b"))
    return n.join(d, ["_a", "_b"]).drop("_a", "_b")


def pair_modes(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """Candidate pairs: modes of one document with the same footprint."""
    t = truth.select("doc_id", "footprint", F.col("mode_idx").alias("truth_mode"))
    return t.join(extracted.select("doc_id", "footprint", F.col("mode_idx").alias("mode")), ["doc_id", "footprint"])


def document_modes(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """doc_id and its modes of both sides as arrays of (mode, footprint, slots)."""

    def side(slots: DataFrame, name: str, *fields: str) -> DataFrame:
        rows = slots.groupBy("doc_id").agg(F.collect_list(F.struct("mode_idx", F.struct("dmx_break", "slot").alias("at"), *fields)).alias("s"))
        modes = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["mode_idx"])))

        def mode(m: Column) -> Column:
            mine = F.array_sort(F.filter("s", lambda x: x["mode_idx"] == m))
            return F.struct(m.alias("mode"), F.size(mine).cast("long").alias("footprint"), mine.alias("slots"))

        return rows.select("doc_id", F.transform(modes, mode).alias(name))

    t = side(truth, "t", "name", "attribute", "n_functions", "fine")
    return t.join(side(extracted, "e", "name", "attribute", "fine_of", "n_ranges"), "doc_id", "full")


def scored_modes(docs: DataFrame) -> DataFrame:
    """A row for each pair of modes of a document with the same footprint, and what its slots score:
    sums and numbers of name ratios, fine bytes, attributes and ranges.

    Fine slots count as found if the extracted slot is a fine byte of something. Coarse ones are
    compared by name if the truth's has letters or digits, and by attribute if it has one as well,
    whatever the case. A missing slot scores 0.
    """
    pairs = F.flatten(F.transform("t", lambda t: F.transform(F.filter("e", lambda e: e["footprint"] == t["footprint"]), lambda e: F.struct(t["footprint"].alias("footprint"), t["mode"].alias("truth_mode"), e["mode"].alias("mode"), t["slots"].alias("ts"), e["slots"].alias("es")))))
    p = docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.footprint", "p.truth_mode", "p.mode", F.explode("p.ts").alias("t"), F.map_from_arrays(F.transform("p.es", lambda x: x["at"]), F.col("p.es")).alias("es"))
    p = p.withColumn("e", F.try_element_at("es", F.col("t.at"))).drop("es")
    coarse, fine = F.col("t.fine") == 0, F.col("t.fine") == 1
    p = p.withColumn("a", norm_name(F.col("t.name"))).withColumn("b", norm_name(F.coalesce("e.name", F.lit(""))))
    p = p.withColumn("ratio", F.when(coarse & (F.col("a") != ""), _ratio("a", "b")))
    trimmed = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    attr = F.col("ratio").isNotNull() & (trimmed("t.attribute") != "")
    rich = coarse & (F.col("t.n_functions") > 1)
    return p.groupBy("doc_id", "footprint", "truth_mode", "mode").agg(
        F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("name_score"),
        F.coalesce(F.sum("ratio"), F.lit(0.0)).alias("name_sum"),
        F.count("ratio").alias("name_n"),
        F.count_if(fine & (F.coalesce("e.fine_of", F.lit("")) != "")).alias("fine_hits"),
        F.count_if(fine).alias("fine_n"),
        F.count_if(attr & (trimmed("t.attribute") == trimmed("e.attribute"))).alias("attr_hits"),
        F.count_if(attr).alias("attr_n"),
        F.count_if(rich & (F.coalesce("e.n_ranges", F.lit(0)) > 1)).alias("rich_hits"),
        F.count_if(rich).alias("rich_n"),
    )


def score_pairs(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    return scored_modes(document_modes(truth, extracted))


def best_of(scores: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairing of greatest sum: exact up to 6 by 6, the first of equals; beyond, each row
    in turn takes the best column that is left."""
    n, m = scores.shape
    if max(n, m) <= 6:
        if n > m:
            best = max(permutations(range(n), m), key=lambda p: (round(sum(scores[i, j] for j, i in enumerate(p)), 9), [-i for i in p]))
            return [(i, j) for j, i in enumerate(best)]
        return list(enumerate(max(permutations(range(m), n), key=lambda p: (round(sum(scores[i, j] for i, j in enumerate(p)), 9), [-j for j in p]))))
    out, left = [], list(range(m))
    for i in range(min(n, m)):
        j = max(left, key=lambda j: (scores[i, j], -j))
        out.append((i, j))
        left.remove(j)
    return out


@F.pandas_udf(ArrayType(BooleanType()))
def _chosen(buckets: pd.Series, truth_modes: pd.Series, modes: pd.Series, scores: pd.Series) -> pd.Series:
    """For a document's pairs, which are in the best pairing of their footprint."""
    out = []
    for sizes, rows, columns, values in zip(buckets, truth_modes, modes, scores):
        keep = np.zeros(len(sizes), bool)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            t, i = np.unique(rows[mine], return_inverse=True)
            e, j = np.unique(columns[mine], return_inverse=True)
            table = np.zeros((len(t), len(e)))
            table[i, j] = values[mine]
            pick = np.zeros(table.shape, bool)
            pick[tuple(zip(*best_of(table)))] = True
            keep[mine] = pick[i, j]
        out.append(keep)
    return pd.Series(out)


def best_pairing(scored: DataFrame, once: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The pairs of each (document, footprint) bucket's best pairing. Buckets with one mode on a side, or two on both, are
    settled by windows; only larger ones go through ``best_of``. What is read twice is put through ``once``, which may write it."""
    names = [c for c in scored.columns if c != "doc_id"]
    w = W.partitionBy("doc_id", "footprint")
    ends = {f"_{f}_{c}": getattr(F, f)(c).over(w) for f in ("min", "max") for c in ("truth_mode", "mode")}
    s = scored.withColumns({**ends, "_n": F.count("*").over(w), "_full": F.least(*[F.count(c).over(w) for c in ("truth_mode", "mode", "name_score")]), "_first": F.min(F.struct((-F.round("name_score", 9)).alias("s"), "truth_mode", "mode")).over(w)})
    first = {c: F.col(c) == F.col(f"_min_{c}") for c in ("truth_mode", "mode")}
    corner = (first["truth_mode"] | (F.col("truth_mode") == F.col("_max_truth_mode"))) & (first["mode"] | (F.col("mode") == F.col("_max_mode")))
    straight = first["truth_mode"] == first["mode"]
    total = lambda c: F.round(F.sum(F.when(c, F.col("name_score"))).over(w), 9)
    s = s.withColumns({"_corners": F.count_if(corner).over(w), "_straight": total(straight) >= total(~straight)})
    full = F.col("_n") == F.col("_full")
    one = full & (F.col("_n") <= 6) & ((F.col("_min_truth_mode") == F.col("_max_truth_mode")) | (F.col("_min_mode") == F.col("_max_mode")))
    two = full & (F.col("_n") == 4) & (F.col("_corners") == 4) & (F.col("_min_truth_mode") < F.col("_max_truth_mode")) & (F.col("_min_mode") < F.col("_max_mode"))
    keep = F.when(one, (F.col("truth_mode") == F.col("_first.truth_mode")) & (F.col("mode") == F.col("_first.mode"))).when(two, F.col("_straight") == straight)
    s = once(s.withColumn("_keep", keep).where("_keep is null or _keep").select("doc_id", *names, "_keep"))
    pair = F.struct("footprint", "truth_mode", "mode", *[c for c in names if c not in ("footprint", "truth_mode", "mode")])
    docs = s.where("_keep is null").groupBy("doc_id").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    docs = docs.withColumn("picked", _chosen(F.col("p.footprint"), F.col("p.truth_mode"), F.col("p.mode"), F.col("p.name_score")))
    large = docs.select("doc_id", F.inline(F.filter("p", lambda x, i: F.get("picked", i)))).select("doc_id", *names)
    return s.where("_keep").select("doc_id", *names).unionByName(large)


def scoreboard(fixtures: DataFrame, identities: DataFrame, truth: DataFrame, extracted: DataFrame, once: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The 22 columns of a scored document: fixtures(fixture_id, manufacturer, model) is the truth,
    identities(fixture_id, file, manufacturer, model) what was extracted. Scores of slots are pooled over
    all of a document's chosen pairs."""
    modes = once(document_modes(truth, extracted))
    b = best_pairing(scored_modes(modes), once).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("name_sum", "name_n", "fine_hits", "fine_n", "attr_hits", "attr_n", "rich_hits", "rich_n")], F.count("*").alias("n_mode_pairs"))
    sizes = lambda c: F.array_sort(F.transform(F.coalesce(F.col(c), F.array().cast(modes.schema[c].dataType)), lambda x: x["footprint"]))
    m = modes.select("doc_id", sizes("t").alias("tc"), sizes("e").alias("ec"))
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    hits = F.aggregate(F.array_distinct("tc"), F.lit(0), lambda n, x: n + F.least(times("tc", x), times("ec", x)))
    m = m.select("doc_id", "tc", "ec", F.try_divide(hits, F.size("tc")).alias("recall"), F.try_divide(hits, F.size("ec")).alias("precision"), F.try_divide(greedy_hits("tc", "ec"), F.size("tc")).alias("tol1"))
    them = identities.select("fixture_id", "file", F.col("manufacturer").alias("extracted_manufacturer"), F.col("model").alias("extracted_model"))
    r = fixtures.select("fixture_id", F.col("manufacturer").alias("brand"), "model").join(them, "fixture_id")
    r = r.join(m.withColumnRenamed("doc_id", "fixture_id"), "fixture_id", "left").join(b.withColumnRenamed("doc_id", "fixture_id"), "fixture_id", "left")
    alike = lambda x, y: _ratio(norm_name(F.col(x)), norm_name(F.col(y)))
    listed = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    return r.select(
        "file", "brand", "model", "extracted_manufacturer", "extracted_model",
        alike("brand", "extracted_manufacturer").alias("manufacturer_score"), alike("model", "extracted_model").alias("model_score"),
        F.col("recall").alias("footprint_recall"), F.col("precision").alias("footprint_precision"), F.col("tol1").alias("footprint_recall_tol1"),
        F.try_divide("name_sum", "name_n").alias("channel_name_score"), F.try_divide("fine_hits", "fine_n").alias("fine_byte_score"), F.try_divide("attr_hits", "attr_n").alias("strict_attribute_score"),
        F.try_divide("rich_hits", "rich_n").alias("range_richness"), F.coalesce("rich_n", F.lit(0)).alias("range_richness_n"), F.coalesce("n_mode_pairs", F.lit(0)).alias("n_mode_pairs"),
        F.coalesce(F.size("tc"), F.lit(0)).cast("long").alias("n_truth_modes"), F.coalesce(F.size("ec"), F.lit(0)).cast("long").alias("n_extracted_modes"), "fixture_id",
        listed("tc").alias("truth_footprints"), listed("ec").alias("extract_footprints"), F.coalesce(F.trim("extracted_model").rlike(FILENAME_ECHO), F.lit(False)).alias("filename_echo"),
    )


def metric_summary(board: DataFrame, metrics: list[str]) -> DataFrame:
    """n, mean, median, least and greatest of each metric over its own non-null values."""
    long = board.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def brand_rollup(board: DataFrame) -> DataFrame:
    """Documents of each brand and the means of three scores over those that have them, most documents first."""
    mean = lambda c: F.round(F.avg(c), 6)
    r = board.groupBy("brand").agg(F.count("*").alias("n"), mean("footprint_recall").alias("mean_recall"), mean("footprint_precision").alias("mean_precision"), mean("channel_name_score").alias("mean_name_score"))
    return r.orderBy(F.desc("n"), "brand")


def health_counts(board: DataFrame) -> DataFrame:
    """Documents of which nothing, and of which all was found, and models that echo the file's name."""
    return board.agg(F.count_if(F.col("footprint_recall") == 0).alias("zero_recall"), F.count_if(F.col("footprint_recall") == 1).alias("perfect_recall"), F.count_if("filename_echo").alias("filename_echo"), F.count("*").alias("n"))


def duplicate_audit(docs: DataFrame) -> DataFrame:
    """Byte-identical documents under several names."""
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.min("doc_id").alias("first_doc")).where("n > 1")


def conflicting_duplicates(docs: DataFrame, footprints: DataFrame, most: int = 1) -> DataFrame:
    """Groups of byte-identical documents (of several ids) whose truths have no more than ``most`` footprints in common.
    ``footprints``: doc_id, footprint. A footprint is common if it belongs to as many documents of the group as it has:
    counts by group and footprint, never pairs of documents."""
    d = docs.select("doc_id", F.md5("text").alias("digest")).distinct()
    groups = d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    held = d.join(footprints.select("doc_id", "footprint").distinct(), "doc_id").groupBy("digest", "footprint").agg(F.count("*").alias("k"))
    common = held.join(groups, "digest").where("k = n").groupBy("digest").agg(F.count("*").alias("n_common"))
    return groups.join(common, "digest", "left").na.fill(0, ["n_common"]).where(F.col("n_common") <= most).select("digest", "n", "first_doc", "n_common")
