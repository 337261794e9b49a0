"""Channel classification: description to name, kind, colour, fine link and attribute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of the record schema and those folded into them, colours, attributes.
KINDS = ["intensity", "colorIntensity", "colorWheel", "colorTemperature", "pan", "tilt", "strobe", "goboWheel", "prism", "focus", "zoom", "iris", "effect", "speed", "maintenance", "mode", "generic"]
TO_EFFECT = ["frost", "shaper", "blade", "animation", "macro", "laser", "fog"]
COLORS = [("red", "RED"), ("green", "GREEN"), ("blue", "BLUE"), ("white", "WHITE"), ("amber", "AMBER"), ("uv", "UV")]
ATTRIBUTES = {"pan": "Pan", "tilt": "Tilt", "intensity": "Dimmer", "strobe": "Shutter1", "colorWheel": "Color1", "goboWheel": "Gobo1", "prism": "Prism1", "focus": "Focus1", "zoom": "Zoom", "iris": "Iris", "colorTemperature": "CTC", "speed": "EffectsSpeed", "mode": "ControlMode", "maintenance": "FixtureGlobalReset"}
COLOR_ATTRIBUTES = {"RED": "ColorAdd_R", "GREEN": "ColorAdd_G", "BLUE": "ColorAdd_B", "WHITE": "ColorAdd_W", "AMBER": "ColorAdd_RY", "UV": "ColorAdd_UV"}
FEATURES = {"Dimmer": ["intensity", "strobe"], "Position": ["pan", "tilt"], "Color": ["colorIntensity", "colorWheel", "colorTemperature"], "Gobo": ["goboWheel"], "Beam": ["prism", "iris", "effect"], "Focus": ["focus", "zoom"]}
# Ordered rules of (pattern, name, kind, zoned). The first that matches wins; a zone
# number behind the word goes into the name; the fine forms come before the plain ones.
RULES = [
    (r"\btilt (speed|time)\b", "Tilt speed", "speed", ""),
    (r"\btilt macro\b", "Tilt macro", "effect", ""),
    (r"(pan.?tilt|x.?y).*(speed|time)", "Pan / tilt speed", "speed", ""),
    (r"fine (pan|x.?axis)|(pan|x.?axis) ?[0-9]* ?(fine|least)", "Pan fine", "pan", "pan"),
    (r"fine (tilt|y.?axis)|(tilt|y.?axis) ?[0-9]* ?(fine|least)", "Tilt fine", "tilt", "tilt"),
    (r"\bpan\b|\bx.?axis\b", "Pan", "pan", "pan"),
    (r"\btilt\b|\by.?axis\b", "Tilt", "tilt", "tilt"),
    (r"\bfine (dimmer|dimming|intensity)\b|\b(dimmer|dimming|intensity)\b.*\bfine\b", "Dimmer fine", "intensity", "dimmer"),
    (r"\b(dimmer|dimming|intensity)\b", "Dimmer", "intensity", "dimmer"),
    (r"\b(focus|focusing)\b.*\bfine\b", "Focus fine", "focus", ""),
    (r"\b(focus|focusing)\b", "Focus", "focus", ""),
    (r"\bfine zoom\b|\bzoom\b.*\bfine\b", "Zoom fine", "zoom", "zoom"),
    (r"\bzoom\b", "Zoom", "zoom", "zoom"),
    (r"\b(ctc|colou?r temperature)\b", "Color temperature", "colorTemperature", ""),
    (r"green ?/ ?magenta|green.*shift|\btint\b", "Green / magenta tint", "effect", ""),
    (r"\bbeamshaper\b", "Beamshaper", "effect", ""),
    (r"\bbackground colou?r\b", "Background color", "colorWheel", ""),
    (r"fixture control ?/? ?settings", "Fixture control / settings", "maintenance", ""),
    (r"\bmode\b", "Mode", "mode", ""),
    (r"\bspeed\b|\bvelocity\b", "Program speed", "speed", ""),
    (r"\bshutter\b", "Shutter / strobe", "strobe", ""),
    (r"\b(strobe|flash)\b", "Light switch / strobe", "strobe", ""),
    (r"colou?r wheel", "Color wheel", "colorWheel", ""),
    (r"gobo", "Gobo wheel", "goboWheel", ""),
    (r"prism", "Prism", "prism", ""),
    (r"\b(reset|lamp on|lamp off|maintenance)\b", "Reset / function", "maintenance", ""),
]


def normalized_description(c: Column) -> Column:
    """Lower case; MSB goes, LSB and 16 bit read as fine."""
    c = F.regexp_replace(F.lower(c), "_", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\bmsb\b", ""), r"\b(lsb|16[ -]?bit)\b", "fine")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def classify(c: Column) -> Column:
    """Struct of name, kind, color and fine_of ('' where there is none)."""
    d = normalized_description(c)
    name, kind, fine = (F.lit(None).cast("string") for _ in range(3))
    out = None
    for pattern, label, kind_, zone in RULES:
        is_fine = label.endswith(" fine")
        zoned = F.lit("")
        if zone:
            word = {"dimmer": "(?:dimmer|dimming|intensity)"}.get(zone, zone)
            zoned = F.regexp_extract(d, rf"\b{word} ([0-9]{{1,3}})", 1)
        plain = label.removesuffix(" fine")
        text = F.concat(F.lit(plain), F.when(zoned != "", F.concat(F.lit(" "), zoned)).otherwise(""), F.lit(" fine" if is_fine else ""))
        base = {"dimmer": "intensity:dimmer"}.get(zone, zone or kind_)
        link = F.concat(F.lit(base), F.when(zoned != "", F.concat(F.lit(":"), zoned)).otherwise("")) if is_fine else F.lit("")
        value = F.struct(text.alias("name"), F.lit(kind_).alias("kind"), F.lit("").alias("color"), link.alias("fine_of"))
        out = F.when(d.rlike(pattern), value) if out is None else out.when(d.rlike(pattern), value)
    for word, color in COLORS:
        pattern = rf"\b(?:(fine) )?{word}(?: ?([0-9]{{1,2}}))?(?: (fine))?\b"
        zone = F.regexp_extract(d, pattern, 2)
        fine = (F.regexp_extract(d, pattern, 1) != "") | (F.regexp_extract(d, pattern, 3) != "")
        label = "UV" if word == "uv" else word.capitalize()
        text = F.concat(F.lit(label), F.when(zone != "", F.concat(F.lit(" "), zone)).otherwise(""), F.when(fine, " fine").otherwise(""))
        link = F.when(fine, F.concat(F.lit(f"colorIntensity:{color}:"), zone)).otherwise("")
        out = out.when(d.rlike(pattern), F.struct(text.alias("name"), F.lit("colorIntensity").alias("kind"), F.lit(color).alias("color"), link.alias("fine_of")))
    return out.otherwise(F.struct(F.substring(F.trim(c), 1, 48).alias("name"), F.lit("generic").alias("kind"), F.lit("").alias("color"), F.lit("").alias("fine_of")))


def fold_kind(c: Column) -> Column:
    return F.when(c.isin(KINDS), c).when(c.isin(TO_EFFECT), "effect").otherwise("generic")


def default_attribute(kind: Column, color: Column) -> Column:
    out = reduce(lambda a, x: a.when((kind == "colorIntensity") & (color == x[0]), x[1]), COLOR_ATTRIBUTES.items(), F.when(F.lit(False), ""))
    return reduce(lambda a, x: a.when(kind == x[0], x[1]), ATTRIBUTES.items(), out).otherwise("NoFeature")


def kind_for_attribute(c: Column) -> Column:
    """Ordered prefix rules from attribute to kind."""
    rules = [("Pan", "pan"), ("Tilt", "tilt"), ("Dimmer", "intensity"), ("Shutter", "strobe"), ("Strobe", "strobe"), ("ColorAdd", "colorIntensity"), ("ColorSub", "colorIntensity"), ("CTC", "colorTemperature"), ("CTO", "colorTemperature"), ("Color", "colorWheel"), ("Gobo", "goboWheel"), ("Prism", "prism"), ("Focus", "focus"), ("Zoom", "zoom"), ("Iris", "iris"), ("Effects", "effect"), ("Control", "mode"), ("FixtureGlobalReset", "maintenance")]
    return reduce(lambda a, x: a.when(c.startswith(x[0]), x[1]), rules, F.when(F.lit(False), "")).otherwise("generic")


def feature_default(kind: Column, feature: Column) -> Column:
    found = reduce(lambda a, x: a.when(kind.isin(x[1]), x[0]), FEATURES.items(), F.when(F.lit(False), "")).otherwise("Control")
    return F.coalesce(F.when(feature != "", feature), found)


def relationship_key(kind: Column, color: Column, name: Column) -> Column:
    """Kind, colour and zone: what links a coarse channel to its fine byte."""
    zone = F.regexp_extract(name, "([0-9]{1,3})", 1)
    return F.concat_ws(":", kind, F.when(color != "", color), F.when(zone != "", zone))


def range_safety(kind: Column, text: Column) -> Column:
    text = F.lower(text)
    steady = text.rlike("open|closed|steady|no function|void")
    return F.when((kind == "strobe") & ~steady, "strobe").when((kind == "maintenance") & text.contains("reset"), "reset").otherwise("normal")
