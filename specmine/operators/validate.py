"""Range algebra, the rules that records must meet, and curation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNEL = ["doc_id", "channel_id"]


def by_start():
    """A channel's ranges in order of their start."""
    return W.partitionBy(*CHANNEL).orderBy("range_start", "range_idx")


def reach() -> Column:
    """The furthest end of the ranges before, -1 ahead of the first."""
    return F.coalesce(F.max("range_end").over(by_start().rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))


def covers_full(ranges: DataFrame) -> DataFrame:
    """Whether a channel's ranges reach 255 from 0 without a gap."""
    r = ranges.withColumn("_ok", F.col("range_start") <= reach() + 1)
    return r.groupBy(*CHANNEL).agg((F.bool_and("_ok") & (F.max("range_end") >= 255)).alias("covers"))


def complete_ranges(channels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges clipped where they overlap, gaps filled, up to 255; none at all is one full range."""
    r = ranges.where("range_start <= range_end").withColumn("_reach", reach())
    clipped = r.where("range_end > _reach").select(*CHANNEL, F.greatest("range_start", F.col("_reach") + 1).alias("range_start"), F.col("range_end"), "name")
    gaps = r.where("range_start > _reach + 1").select(*CHANNEL, (F.col("_reach") + 1).alias("range_start"), (F.col("range_start") - 1).alias("range_end"), F.lit("Unspecified").alias("name"))
    tops = r.groupBy(*CHANNEL).agg(F.max("range_end").alias("top"))
    tail = tops.where("top < 255").select(*CHANNEL, (F.col("top") + 1).alias("range_start"), F.lit(255).alias("range_end"), F.lit("Unspecified").alias("name"))
    none = channels.select(*CHANNEL).distinct().join(tops, CHANNEL, "left_anti").select(*CHANNEL, F.lit(0).alias("range_start"), F.lit(255).alias("range_end"), F.lit("Full range").alias("name"))
    return clipped.unionByName(gaps).unionByName(tail).unionByName(none)


def scale_16bit(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("wide_start", F.col("range_start") * 257).withColumn("wide_end", F.when(F.col("range_end") == 255, 65535).otherwise((F.col("range_end") + 1) * 257 - 1))


def risky_range(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """The first range that isn't normal and holds a value."""
    j = values.join(ranges.where("safety <> 'normal'"), CHANNEL).where("value between range_start and range_end")
    w = W.partitionBy(*CHANNEL, "value").orderBy("range_idx")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*CHANNEL, "value", "range_idx", "safety")


# ---- rules: each gives (doc_id, level, code, path, message); those of one table are tested in one pass


def _at(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _rule(broken: Column, level: str, code: str, path: Column, message: Column | str) -> Column:
    """The issue of a row, null where the rule isn't broken."""
    return F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def _issues(df: DataFrame, *rules: Column) -> DataFrame:
    return df.select("doc_id", F.inline(F.array_compact(F.array(*rules))))


def identity_rules() -> list[Column]:
    return [_rule(F.trim(F.coalesce(c, F.lit(""))) == "", "error", "identity." + c, F.lit("identity." + c), f"{c} is blank") for c in ("manufacturer", "model")]


def v_identity(fixtures: DataFrame) -> DataFrame:
    return _issues(fixtures, *identity_rules())


def v_no_modes(fixtures: DataFrame, modes: DataFrame) -> DataFrame:
    return _issues(fixtures.join(modes, "doc_id", "left_anti"), _rule(F.lit(True), "error", "modes.none", F.lit("modes"), "no modes"))


def _numbered_ranges(ranges: DataFrame) -> DataFrame:
    path = _at(F.col("channel_id"), ".ranges[", F.row_number().over(by_start()) - 1, "]")
    return ranges.withColumn("_p", path).withColumn("_e", F.lag("range_end").over(by_start()))


def range_rules() -> dict[str, Column]:
    """An overlap is with the previous range in sorted order only, not the furthest end so far."""
    p = F.col("_p")
    return {
        "reversed": _rule(F.expr("range_start > range_end"), "error", "range.reversed", p, "start is after end"),
        "overlap": _rule(F.expr("range_start <= _e"), "error", "range.overlap", p, "overlaps the range before"),
        "uncertain": _rule(F.expr("confidence < 0.6"), "warning", "range.uncertain", p, "low confidence"),
        "safety": _rule(F.expr("safety <> 'normal' and trim(name) = ''"), "warning", "range.safety", p, "safety without a name"),
    }


def v_range_reversed(ranges: DataFrame) -> DataFrame:
    return _issues(_numbered_ranges(ranges), range_rules()["reversed"])


def v_range_overlap(ranges: DataFrame) -> DataFrame:
    return _issues(_numbered_ranges(ranges), range_rules()["overlap"])


def v_range_uncertain(ranges: DataFrame) -> DataFrame:
    return _issues(_numbered_ranges(ranges), range_rules()["uncertain"])


def v_safety_unnamed(ranges: DataFrame) -> DataFrame:
    return _issues(_numbered_ranges(ranges), range_rules()["safety"])


def _known_channels(channels: DataFrame, name: str) -> DataFrame:
    return channels.select("doc_id", F.col("channel_id").alias(name)).distinct().withColumn("_known", F.lit(True))


def _numbered_channels(channels: DataFrame) -> DataFrame:
    w = W.partitionBy(*CHANNEL).orderBy("channel_idx")
    return channels.withColumn("_r", F.row_number().over(w)).join(_known_channels(channels, "fine_of"), ["doc_id", "fine_of"], "left")


def channel_rules() -> dict[str, Column]:
    path = _at("channels[", F.col("channel_idx"), "]")
    return {
        "duplicate": _rule(F.col("_r") > 1, "error", "channel.duplicate", path, _at("duplicate id ", F.col("channel_id"))),
        "fine": _rule(F.col("fine_of").isNotNull() & F.col("_known").isNull(), "error", "channel.fine", path, _at("fine of absent ", F.col("fine_of"))),
    }


def v_duplicate_channel(channels: DataFrame) -> DataFrame:
    return _issues(_numbered_channels(channels), channel_rules()["duplicate"])


def v_fine_missing(channels: DataFrame) -> DataFrame:
    return _issues(_numbered_channels(channels), channel_rules()["fine"])


def slot_rules() -> dict[str, Column]:
    path = _at("modes[", F.col("mode_idx"), "].channels[", F.col("slot_idx"), "]")
    return {
        "channel": _rule(F.expr("_known is null"), "error", "slot.channel", path, _at("absent channel ", F.col("channel_id"))),
        "offset": _rule(F.expr("channel_offset not between 1 and 512"), "error", "slot.offset", path, _at("offset ", F.col("channel_offset"))),
        "break": _rule(F.expr("dmx_break < 1 or dmx_break > greatest(breaks, 1)"), "error", "slot.break", path, _at("break ", F.col("dmx_break"))),
        "overlap": _rule(F.expr("_h is not null"), "error", "slot.overlap", path, _at("already held by ", F.col("_h"))),
    }


def _with_holder(assignments: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id", "mode_idx", "dmx_break", "channel_offset").orderBy("slot_idx")
    return assignments.withColumn("_h", F.lag("channel_id").over(w))


def _with_breaks(assignments: DataFrame, modes: DataFrame) -> DataFrame:
    return assignments.join(modes.select("doc_id", "mode_idx", "breaks"), ["doc_id", "mode_idx"], "left")


def v_unknown_channel(assignments: DataFrame, channels: DataFrame) -> DataFrame:
    return _issues(assignments.join(_known_channels(channels, "channel_id"), CHANNEL, "left"), slot_rules()["channel"])


def v_offset(assignments: DataFrame) -> DataFrame:
    return _issues(assignments, slot_rules()["offset"])


def v_break(assignments: DataFrame, modes: DataFrame) -> DataFrame:
    return _issues(_with_breaks(assignments, modes).where("breaks is not null"), slot_rules()["break"])


def v_slot_overlap(assignments: DataFrame) -> DataFrame:
    return _issues(_with_holder(assignments), slot_rules()["overlap"])


def v_matrix_count(matrices: DataFrame) -> DataFrame:
    """matrices: doc_id, x, y, z, n_pixels."""
    return _issues(matrices, _rule(F.expr("n_pixels > 0 and n_pixels <> x * y * greatest(z, 1)"), "warning", "matrix.count", F.lit("matrix"), _at(F.col("n_pixels"), " pixels")))


def validate(fixtures: DataFrame, channels: DataFrame, ranges: DataFrame, modes: DataFrame, assignments: DataFrame, matrices: DataFrame) -> DataFrame:
    """All rules as one issue table: a pass over each table."""
    slots = _with_breaks(_with_holder(assignments), modes).join(_known_channels(channels, "channel_id"), CHANNEL, "left")
    slot = slot_rules() | {"break": F.when(F.col("breaks").isNotNull(), slot_rules()["break"])}
    parts = [v_identity(fixtures), v_no_modes(fixtures, modes), _issues(_numbered_channels(channels), *channel_rules().values()), _issues(_numbered_ranges(ranges), *range_rules().values()), _issues(slots, *slot.values()), v_matrix_count(matrices)]
    return reduce(DataFrame.unionByName, parts)


def exportable(fixtures: DataFrame, issues: DataFrame) -> DataFrame:
    return fixtures.join(issues.where("level = 'error'").select("doc_id").distinct(), "doc_id", "left_anti")


# Fixed value: words of lights that are dimmed by their mains.
MAINS = r"(?i)(phase cut|triac dimmer|mains dim)"


def unknown(c: str) -> Column:
    return (F.trim(c) == "") | F.col(c).startswith("Unknown")


def review_queue(fixtures: DataFrame, channels: DataFrame, modes: DataFrame, wheels: DataFrame, texts: DataFrame) -> DataFrame:
    """Help prompts (doc_id, prompt, subject) of a document: no channels (and whether its text describes a light dimmed by its mains), no maker, no
    model, both but unsure; of a document with modes the first 6 incomplete ones, of others the first 3 unsure channels, by
    number; an unsure colour wheel, a gobo wheel, a locked reset. modes: doc_id, mode_idx, name, size, parsed; wheels: doc_id,
    kind, confidence; texts: doc_id, text."""
    ask = lambda df, prompt, subject=None: df.select("doc_id", F.lit(prompt).alias("prompt"), (F.lit("") if subject is None else subject).alias("subject"))
    bare = fixtures.select("doc_id").join(channels.select("doc_id").distinct(), "doc_id", "left_anti").join(texts.select("doc_id", F.col("text").rlike(MAINS).alias("mains")), "doc_id", "left")
    none = bare.select("doc_id", F.when(F.col("mains"), "channels.mains").otherwise("channels.none").alias("prompt"), F.lit("").alias("subject"))
    maker, model = ask(fixtures.where(unknown("manufacturer")), "identity.manufacturer"), ask(fixtures.where(unknown("model")), "identity.model")
    unsure = ask(fixtures.where(~unknown("manufacturer") & ~unknown("model") & (F.col("confidence") < 0.5)), "identity.confidence")
    wm = W.partitionBy("doc_id").orderBy("mode_idx")
    read = F.concat_ws(" ", "name", F.concat_ws("/", F.col("parsed").cast("string"), F.col("size").cast("string")))
    thin = ask(modes.where("parsed < size").withColumn("_r", F.row_number().over(wm)).where("_r <= 6"), "mode.incomplete", read)
    wc = W.partitionBy("doc_id").orderBy("channel_idx")
    weak = channels.where("confidence < 0.6").join(modes.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("_r", F.row_number().over(wc)).where("_r <= 3")
    weak = ask(weak, "channel.confidence", (F.col("channel_idx") + 1).cast("string"))
    colours = ask(wheels.where("kind = 'color' and confidence < 0.6").select("doc_id").distinct(), "wheel.color")
    gobos = ask(wheels.where("kind = 'gobo'").select("doc_id").distinct(), "wheel.gobo")
    locked = ask(channels.where("kind = 'maintenance'").select("doc_id").distinct(), "channel.reset")
    return reduce(DataFrame.unionByName, [none, maker, model, unsure, thin, weak, colours, gobos, locked])


def apply_name_edits(fixtures: DataFrame, edits: DataFrame) -> DataFrame:
    """Maker and model after curators' edits (doc_id, manufacturer, model, ts, event_id): the latest that isn't blank, each."""
    last = lambda c: F.max_by(F.when(F.trim(c) != "", F.trim(c)), F.when(F.trim(c) != "", F.struct("ts", "event_id"))).alias(f"_{c}")
    e = edits.groupBy("doc_id").agg(last("manufacturer"), last("model"))
    return fixtures.join(e, "doc_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("manufacturer", "model")}).drop("_manufacturer", "_model")


def open_prompts(queue: DataFrame, edited_channels: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The prompts that edits leave open: one about a channel goes when a channel whose number its own begins with was
    edited (edited_channels: doc_id, channel_idx), one about a name when that isn't unknown any more."""
    done = edited_channels.select(F.col("doc_id").alias("_d"), (F.col("channel_idx") + 1).cast("string").alias("_n")).distinct()
    left = queue.join(done, (F.col("prompt") == "channel.confidence") & (F.col("doc_id") == F.col("_d")) & F.col("subject").startswith(F.col("_n")), "left_anti")
    named = fixtures.select("doc_id", F.explode(F.array_compact(F.array(F.when(~unknown("manufacturer"), "identity.manufacturer"), F.when(~unknown("model"), "identity.model")))).alias("prompt"))
    return left.join(named, ["doc_id", "prompt"], "left_anti")


def apply_edits(channels: DataFrame, edits: DataFrame) -> DataFrame:
    """The latest edit of each channel (doc_id, channel_idx, name, kind, ts, event_id); a blank
    keeps the old value, an edited channel is sure."""
    last = edits.groupBy("doc_id", "channel_idx").agg(F.max_by(F.struct("name", "kind"), F.struct("ts", "event_id")).alias("e"))
    kept = lambda c: F.coalesce(F.nullif(F.trim(f"e.{c}"), F.lit("")), F.col(c))
    return channels.join(last, ["doc_id", "channel_idx"], "left").select("doc_id", "channel_idx", kept("name").alias("name"), kept("kind").alias("kind"), F.when(F.col("e").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))
