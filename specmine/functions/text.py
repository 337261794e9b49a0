"""Text columns: normal forms, keys, ranges, similarity. All built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dash-like separators of ranges, and spellings repaired in channel tables.
RANGE = r"([0-9]{1,3})\s*(?:-|–|—|~|to|\.\.)\s*([0-9]{1,3})"
REPAIRS = [("^eset\\b", "Reset"), ("^ocusing\\b", "Focusing"), ("^hutter\\b", "Shutter"), ("^imming\\b", "Dimming")]


def ascii_edges(pattern: str) -> str:
    r"""A pattern whose \b parts ASCII letters, digits and _ from all else, as in the SQL: Java's own takes ä for a letter too."""

    def edge(m: re.Match) -> str:
        ahead, behind = m.string[m.end() : m.end() + 2], m.string[: m.start()]
        if re.match("[A-Za-z0-9_](?![*?{])", ahead):
            return r"(?<!\w)"
        return r"(?!\w)" if re.search(r"(?<!\\)[A-Za-z0-9_]$", behind) else r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

    return re.sub(r"(?<!\\)\\b", edge, pattern)


def flatten_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_line(c: Column) -> Column:
    """Grid glyphs become spaces, a dot or tilde between digits a dash, a glued 0-2xx is split."""
    c = F.regexp_replace(c, r"[|\[\]{}]", " ")
    c = F.regexp_replace(c, r"([0-9])[._~]([0-9])", "$1-$2")
    return F.regexp_replace(flatten_text(c), r"\b(0{1,3})(2[0-9]{2})\b", "$1-$2")


def clean_function(c: Column) -> Column:
    """A function name without edge punctuation, lost first letters put back, table names unified."""
    c = F.regexp_replace(c, r"^[|:;.,\-_~\"'`\s]+|[|:;.,\s]+$", "")
    c = flatten_text(c)
    for pattern, text in REPAIRS:
        c = F.regexp_replace(c, "(?i)" + pattern, text)
    c = F.regexp_replace(c, r"(?i)^ight\s+(strip|band)\b", "Light $1")
    table = r"(?i)^[mv]ode[_\s-]*table[_\s-]*\(?([12id])\)?"
    return F.when(c.rlike(table), F.concat(F.when(F.regexp_extract(c, table, 1) == "2", "Mode table 2").otherwise("Mode table 1"), F.regexp_replace(c, table, ""))).otherwise(c)


def is_page_furniture(c: Column) -> Column:
    return F.ltrim(c).startswith("=") | c.rlike(ascii_edges(r"(?i)^(page|p\.?\s*[0-9]|rev(ision)?|user manual|contents?)\b")) | c.rlike(ascii_edges(r"(?i)\buser manual\b"))


def range_start(c: Column) -> Column:
    return F.regexp_extract(c, RANGE, 1).try_cast("int")


def range_end(c: Column) -> Column:
    return F.regexp_extract(c, RANGE, 2).try_cast("int")


def parse_range(c: Column, kind: Column | None = None, wide: bool = False) -> Column:
    """Struct of start, end and label; null unless 0 <= start <= end <= 255. Percent ranges are
    none. ``wide`` reads 256..269 as 255."""
    kind = F.lit("generic") if kind is None else kind
    start, end = range_start(c), range_end(c)
    if wide:
        end = F.when(end.between(256, 269), 255).otherwise(end)
    label = F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, f"^.*?{RANGE}", ""), r"^[\s:=-]+", "")), 1, 80)
    label = F.when(label == "", F.when(kind == "intensity", "Brightness").otherwise("Full range")).otherwise(label)
    good = start.isNotNull() & end.isNotNull() & (start <= end) & (end <= 255) & ~c.rlike(RANGE + r"\s*%")
    return F.when(good, F.struct(start.alias("start"), end.alias("end"), label.alias("label")))


def ocr_fold(c: Column) -> Column:
    """Characters that scanners confuse become one of each set; only letters and digits stay."""
    return F.regexp_replace(F.translate(F.lower(c), "il|!oszb", "11110528"), "[^a-z0-9]", "")


def edit_similarity(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def slug(*parts: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def brand_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def attribute_key(c: Column) -> Column:
    """Lower-case words, letters parted from digits, without one last number and one fine mark."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "([a-z])([0-9])", "$1 $2"), "([0-9])([a-z])", "$1 $2")
    c = F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    c = F.regexp_replace(c, " [0-9]+$", "")
    return F.regexp_replace(c, " (fine|lsb|16 bit)$", "")


def attribute_template(c: Column) -> Column:
    """The first run of digits becomes (n); only bare tokens have a template."""
    return F.when(c.rlike("^[A-Za-z0-9_]+$"), F.regexp_replace(c, "^([A-Za-z_]*?)[0-9]+", "$1(n)"))


def clean_text(c: Column, n: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " ")), 1, n)


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def normalize_name(c: Column) -> Column:
    c = F.translate(F.lower(c), *ACCENTS)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "&", " and "), "[^a-z0-9]+", " "))


def text_score(a: Column, b: Column) -> Column:
    """1 if equal, 0.88 if one holds the other (of 4 characters or more), else Jaccard of words."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    jaccard = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    inside = ((F.length(b) >= 4) & a.contains(b)) | ((F.length(a) >= 4) & b.contains(a))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, 0.88).otherwise(jaccard)


def stable_uuid(c: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
