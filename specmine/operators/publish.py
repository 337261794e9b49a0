"""Publishing tables: capabilities, open-format records and flat interchange rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmine.functions.channels import default_attribute, feature_default

# Channel kinds to capability types.
TYPES = {"intensity": "Intensity", "colorIntensity": "ColorIntensity", "pan": "Pan", "tilt": "Tilt", "strobe": "ShutterStrobe", "speed": "EffectSpeed", "prism": "Prism", "focus": "Focus", "zoom": "Zoom", "maintenance": "Maintenance", "goboWheel": "WheelSlot", "colorWheel": "WheelSlot"}


def capability_rows(channels: DataFrame, ranges: DataFrame) -> DataFrame:
    """A range's capability type, colour and shutter effect; a wheel range without a slot is generic.
    ranges may carry wheel_slot."""
    slot = F.col("wheel_slot") if "wheel_slot" in ranges.columns else F.lit(None).cast("int")
    j = ranges.join(channels.select("doc_id", "channel_idx", "channel_id", "kind", "color"), ["doc_id", "channel_id"])
    return j.select("doc_id", "channel_idx", "range_idx", capability_type(slot).alias("type"), color_name().alias("color"), shutter_effect(F.col("name")).alias("shutter_effect"))


def capability_type(slot: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    wheel = F.col("kind").isin("goboWheel", "colorWheel")
    return F.when(wheel & slot.isNull(), "Generic").otherwise(F.coalesce(F.try_element_at(types, F.col("kind")), F.lit("Generic")))


def color_name() -> Column:
    return F.when(F.col("kind") == "colorIntensity", F.coalesce(F.initcap(F.nullif("color", F.lit(""))), F.lit("White")))


def shutter_effect(name: Column) -> Column:
    return F.when(F.col("kind") == "strobe", F.when(F.lower(name).rlike("off|closed"), "Closed").when(F.lower(name).rlike("on|open"), "Open").otherwise("Strobe"))


def open_format_docs(fixtures: DataFrame, channels: DataFrame, ranges: DataFrame, modes: DataFrame, assignments: DataFrame, wheels: DataFrame) -> DataFrame:
    """One JSON string for each fixture: channels by id (fine ones are aliases of their coarse one; a
    single capability has no range), a mode for each break that holds channels, wheels of two slots or more.

    wheels: doc_id, wheel_id, kind, number, name, color. Of channels with one id the last stands.
    """
    order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.dropFields("_o"))
    slot_of = F.col("wheel_slot") if "wheel_slot" in ranges.columns else F.lit(None).cast("int")
    one = F.struct(F.col("range_idx").alias("_o"), "name", "range_start", "range_end", slot_of.alias("slot"))
    # everything meets by document alone, so that one shuffle of each table serves all of it
    by_id = lambda df, value: df.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("channel_id", value))).alias(f"_{value}"))
    r = by_id(ranges.where("channel_id is not null").groupBy("doc_id", "channel_id").agg(order(one).alias("ranges")), "ranges")
    fine = by_id(channels.where("fine_of is not null").groupBy("doc_id", F.col("fine_of").alias("channel_id")).agg(F.min_by("channel_id", "channel_idx").alias("fine")), "fine")
    own = F.struct(capability_type(F.lit(None).cast("int")).alias("type"), F.col("name").alias("comment"), color_name().alias("color"), shutter_effect(F.col("name")).alias("shutterEffect"))
    cap = lambda x: F.struct(capability_type(x["slot"]).alias("type"), x["name"].alias("comment"), F.array(x["range_start"], x["range_end"]).alias("dmxRange"), color_name().alias("color"), shutter_effect(x["name"]).alias("shutterEffect"))
    bare = F.transform("caps", lambda x: x.dropFields("dmxRange"))
    obj = F.struct(
        F.when(F.coalesce(F.size("caps"), F.lit(0)) <= 1, F.coalesce(F.get(bare, F.lit(0)), own)).alias("capability"),
        F.when(F.size("caps") > 1, F.col("caps")).alias("capabilities"),
        F.when(F.col("fine").isNotNull(), F.array("fine")).alias("fineChannelAliases"),
        F.when(F.col("fine").isNotNull(), "16bit").alias("dmxValueResolution"),
    )
    ch = channels.where("fine_of is null").join(r, "doc_id", "left").join(fine, "doc_id", "left")
    ch = ch.withColumn("fine", F.try_element_at("_fine", F.col("channel_id"))).withColumn("caps", F.transform(F.try_element_at("_ranges", F.col("channel_id")), cap)).drop("_ranges", "_fine")
    ch = ch.groupBy("doc_id", "channel_id").agg(F.max_by(obj, F.col("channel_idx")).alias("o")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel_id", "o")))).alias("availableChannels"))
    slots = assignments.groupBy("doc_id", "mode_idx", "dmx_break").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot_idx", "channel_id"))), lambda x: x["channel_id"]).alias("channels"))
    slots = slots.groupBy("doc_id", F.col("mode_idx").alias("_mode")).agg(F.collect_list(F.struct("dmx_break", "channels")).alias("_s")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("_mode", "_s"))).alias("_slots"))
    held = modes.join(slots, "doc_id").withColumn("_s", F.explode(F.try_element_at("_slots", F.col("mode_idx")))).select("*", "_s.dmx_break", "_s.channels").where("dmx_break between 1 and greatest(breaks, 1)")
    title = F.when(F.col("breaks") > 1, F.concat("name", F.lit(" — Universe "), F.col("dmx_break").cast("string"))).otherwise(F.col("name"))
    m = held.groupBy("doc_id").agg(order(F.struct(F.struct("mode_idx", "dmx_break").alias("_o"), title.alias("name"), "channels")).alias("modes"))
    is_open = (F.col("number") == 1) & F.lower("name").contains("open")
    slot = F.struct(F.col("number").alias("_o"), F.when(is_open, "Open").when(F.col("kind") == "color", "Color").when(F.col("kind") == "prism", "Prism").otherwise("Gobo").alias("type"), F.when(~is_open, F.col("name")).alias("name"), F.when(~is_open & (F.col("kind") == "color") & F.col("color").isNotNull(), F.array("color")).alias("colors"))
    w = wheels.groupBy("doc_id", "wheel_id").agg(order(slot).alias("slots")).where("size(slots) >= 2").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("wheel_id", F.struct("slots").alias("w"))))).alias("wheels"))
    j = fixtures.join(ch, "doc_id", "left").join(m, "doc_id", "left").join(w, "doc_id", "left")
    day = F.col("imported").cast("string")
    date = F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(day, 1, 10)).otherwise("1970-01-01")
    doc = F.struct(F.col("model").alias("name"), F.col("model").alias("shortName"), F.array(F.coalesce("category", F.lit("Other"))).alias("categories"), F.struct(date.alias("createDate"), date.alias("lastModifyDate")).alias("meta"), F.coalesce("availableChannels", F.create_map().cast(j.schema["availableChannels"].dataType)).alias("availableChannels"), F.coalesce("modes", F.array().cast(j.schema["modes"].dataType)).alias("modes"), "wheels")
    return j.select("doc_id", F.to_json(doc).alias("json"))


def gdtf_channels(mode_rows: DataFrame) -> DataFrame:
    """Flat interchange rows of modes: attribute, feature and "coarse,fine" offsets; a fine row
    belongs to the coarse one right before it."""
    w = W.partitionBy("doc_id", "mode_idx").orderBy("position")
    fine = F.col("name").rlike(r"(?i)\b(fine|lsb)\b")
    r = mode_rows.withColumn("is_fine", fine).withColumn("_n", F.lead(F.struct("is_fine", "position", "kind")).over(w)).where("not is_fine")
    pair = F.coalesce(F.col("_n.is_fine") & (F.col("_n.kind") == F.col("kind")), F.lit(False))
    offset = F.when(pair, F.concat_ws(",", F.col("position").cast("string"), F.col("_n.position").cast("string"))).otherwise(F.col("position").cast("string"))
    return r.select("doc_id", "mode_idx", "position", offset.alias("offset"), default_attribute(F.col("kind"), F.col("color")).alias("attribute"), feature_default(F.col("kind"), F.lit("")).alias("feature"))


def gdtf_attributes(mode_rows: DataFrame) -> DataFrame:
    """Attributes of each document, in the order first seen."""
    a = gdtf_channels(mode_rows).groupBy("doc_id", "attribute", "feature").agg(F.min(F.struct("mode_idx", "position")).alias("first"))
    return a.select("doc_id", "attribute", "feature", F.row_number().over(W.partitionBy("doc_id").orderBy("first", "attribute")).alias("ord"))


def gdtf_feature_groups(channels: DataFrame) -> DataFrame:
    """Feature groups and features of a document's coarse channels, in the order first seen; a feature without a group's
    part is "Control"."""
    part = F.split(feature_default(F.col("kind"), F.col("gdtf_feature")), r"\.")
    f = channels.where("fine_of is null").select("doc_id", "channel_idx", part[0].alias("feature_group"), F.coalesce(F.get(part, F.lit(1)), F.lit("Control")).alias("feature"))
    first = f.groupBy("doc_id", "feature_group", "feature").agg(F.min("channel_idx").alias("at"))
    return first.select("doc_id", "feature_group", "feature", F.row_number().over(W.partitionBy("doc_id").orderBy("at", "feature_group", "feature")).alias("ord"))


def gdtf_wheel_slots(wheels: DataFrame) -> DataFrame:
    """Slots of each wheel, numbered from 1 in their order. ``wheels``: doc_id, wheel_id, number, name."""
    return wheels.select("doc_id", "wheel_id", F.row_number().over(W.partitionBy("doc_id", "wheel_id").orderBy("number", "name")).alias("slot"), "name")


def completed_ranges(channels: DataFrame, ranges: DataFrame) -> DataFrame:
    """0 to 255 without gap or overlap for every channel: range_start, range_end, name and ``source`` (place of the range by
    start, from 0; null for what was filled in)."""
    order = W.partitionBy("doc_id", "channel_id").orderBy("range_start", "range_idx")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    r = ranges.where("range_start <= range_end and range_start <= 255").withColumn("source", F.row_number().over(order) - 1).withColumn("_next", F.coalesce(F.max("range_end").over(before), F.lit(-1)) + 1)
    r = r.where("range_end >= _next").withColumn("_last", F.lead("range_start").over(order).isNull())
    row = lambda a, b, name, source: F.struct(a.alias("range_start"), b.alias("range_end"), name.alias("name"), source.alias("source"))
    none, gap = F.lit(None).cast("int"), F.lit("Unspecified")
    end = F.least("range_end", F.lit(255))
    own = row(F.greatest("range_start", "_next"), end, F.col("name"), F.col("source"))
    rows = F.array(F.when(F.col("range_start") > F.col("_next"), row(F.col("_next"), F.col("range_start") - 1, gap, none)), own, F.when(F.col("_last") & (end < 255), row(end + 1, F.lit(255), gap, none)))
    done = r.select("doc_id", "channel_id", F.explode(F.array_compact(rows)).alias("x")).select("doc_id", "channel_id", "x.*")
    full = channels.select("doc_id", "channel_id").distinct().join(r.select("doc_id", "channel_id").distinct(), ["doc_id", "channel_id"], "left_anti")
    return done.unionByName(full.select("doc_id", "channel_id", F.lit(0).alias("range_start"), F.lit(255).alias("range_end"), F.lit("Full range").alias("name"), none.alias("source")))


def gdtf_functions(mode_rows: DataFrame, channels: DataFrame, ranges: DataFrame, wheel_slots: DataFrame) -> DataFrame:
    """Channel functions of every coarse row of a mode: bounds in steps of a byte, or of two bytes where the row has a fine
    one, and for wheels the slot of the range's own number, if the wheel has it. ``wheel_slots``: doc_id, channel_id, slot."""
    c = gdtf_channels(mode_rows).join(mode_rows.select("doc_id", "mode_idx", "position", "channel_id"), ["doc_id", "mode_idx", "position"])
    f = c.join(completed_ranges(channels, ranges), ["doc_id", "channel_id"])
    n_slots = wheel_slots.groupBy("doc_id", "channel_id").agg(F.max("slot").alias("_slots"))
    f = f.join(n_slots, ["doc_id", "channel_id"], "left")
    wide = F.col("offset").contains(",")
    start = F.when(wide, F.col("range_start") * 257).otherwise(F.col("range_start"))
    end = F.when(wide & (F.col("range_end") == 255), 65535).when(wide, (F.col("range_end") + 1) * 257 - 1).otherwise(F.col("range_end"))
    number = F.row_number().over(W.partitionBy("doc_id", "mode_idx", "position", "channel_id").orderBy("range_start"))
    return f.select("doc_id", "mode_idx", "position", "channel_id", number.alias("fn"), "name", "attribute", start.alias("dmx_from"), end.alias("dmx_to"), F.when(F.col("source") < F.col("_slots"), F.col("source") + 1).alias("wheel_slot"))
