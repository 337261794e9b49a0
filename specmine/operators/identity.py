"""Identity: which maker and model a manual is about, and how sure that is.

Brand spellings are a catalog table, of which an automaton finds all in one pass over a text. Everything
that needs a manual's text (candidates, whole-word offsets, contexts, models nearby, phrases that name the
maker) is taken in the manual's own row, so texts are never shuffled; only what was found goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmine.functions.text import RANGE, ascii_edges, edit_similarity, flatten_text, ocr_fold, slug

# Honorifics and roles ahead of person names, phrases around the name of one's own
# product, words that aren't model names.
PERSON = ["mr", "mrs", "ms", "dr", "by", "author", "designer", "engineer", "manager"]
BOUGHT = ("purchasing this ", "buying this ")
TITLE = r"^([A-Z][A-Za-z0-9]+(?: [A-Z0-9][A-Za-z0-9]*)+)"
KIND = r"(?:user[ \t]+manual|owner'?s?[ \t]+manual|programming[ \t]+manual|instructions?[ \t]+manual|user[ \t]+instructions|dmx[ \t]+traits)"
STOPWORDS = ["this", "the", "a", "an", "your", "our", "my", "its", "read", "see", "review", "entire", "complete", "following", "above", "before", "use", "safety", "service", "general", "advanced", "important", "basic", "quick", "full", "technical", "programming", "installation", "operation", "operating", "troubleshooting", "maintenance", "reference"]
DOC_WORDS = ["manual", "user", "guide", "dmx", "chart", "instructions", "quick", "start", "rev", "version"]


def boundary_of(text: Column, marker: str = r"=== PAGE [0-9]+ ===") -> Column:
    """Offset of the third page marker, else the length of the text."""
    pieces = F.split(text, marker, -1)
    marks = F.regexp_extract_all(text, F.lit(f"({marker})"), F.lit(1))
    third = F.aggregate(F.slice(pieces, 1, 3), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(marks, 1, 2), F.lit(0), lambda a, p: a + F.length(p))
    return F.when(F.size(marks) >= 3, third).otherwise(F.length(text))


def early_boundary(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", boundary_of(F.col("text")).alias("boundary"))


def spellings(catalog: DataFrame) -> DataFrame:
    """(canonical, spelling): the name and its aliases."""
    return catalog.select("canonical", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("spelling"))


def spread(docs: DataFrame) -> DataFrame:
    """Texts of a small input over all cores: one that has fewer parts than there are is dealt out."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < cores else docs


FOUND = "array<struct<canonical:string,strong:boolean,at:array<int>,itself:boolean>>"
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
MARKS = ("©", "®", "™")  # a mark ahead of a name belongs to its place


def spelling_finder(rows: list[tuple[str, str, bool]]) -> Callable[[str], list[dict]]:
    """All spellings' (canonical, spelling in lower case, strong) finder: one pass over a text, whatever their number."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    names: list[tuple[str, bool]] = []
    number: dict[str, int] = {}
    for canonical, spelling, strong in rows:
        if canonical not in number:
            number[canonical] = len(names)
            names.append((canonical, strong))
        of.setdefault(spelling, []).append(number[canonical])
    machine = ahocorasick.Automaton()
    for spelling, brands in of.items():
        machine.add_word(spelling, (len(spelling), brands))
    machine.make_automaton()

    def edge(text: str, at: int) -> bool:
        """Whether no letter or digit stands at this place."""
        return not 0 <= at < len(text) or text[at] not in LETTERS

    def found(text: str) -> list[dict]:
        seen: dict[int, tuple[set[int], list[bool]]] = {}
        for last, (size, brands) in machine.iter(text) if of else ():
            start, end = last + 1 - size, last + 1
            whole = edge(text, start - 1) and edge(text, end)
            own = text.startswith("this ", start - 5) and start >= 5 and own_product(text, start, end)
            for b in brands:
                offsets, itself = seen.setdefault(b, (set(), []))
                if whole:
                    offsets.add(start - (text[start - 1 : start] in MARKS and edge(text, start - 2)))
                if own:
                    itself.append(True)
        return [{"canonical": names[b][0], "strong": names[b][1], "at": sorted(at), "itself": bool(itself)} for b, (at, itself) in sorted(seen.items())]

    return found


def own_product(text: str, start: int, end: int) -> bool:
    """ "purchasing (or buying) this X" or "this X product" of what stands from start to end."""
    word = lambda at: 0 <= at < len(text) and (text[at] in LETTERS or text[at] == "_")
    if text.endswith(BOUGHT, 0, start) and word(end - 1) != word(end):
        return True
    return not word(start - 6) and text.startswith(" product", end) and not word(end + 8)


def brand_finder(known: Broadcast) -> Callable[[str], Column]:
    @F.pandas_udf(FOUND)
    def brands(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = spelling_finder(known.value)
        for texts in parts:
            yield pd.Series([None if x is None else find(x) for x in texts], dtype=object)

    return brands


def with_brands(docs: DataFrame, catalog: DataFrame, limit: int = 500_000) -> DataFrame:
    """``docs`` with ``_brand`` (canonical, strong, at: its whole-word offsets, itself: named as the text's own product) for each
    brand of which the flat text holds a spelling, whatever the case.

    The catalog is a stated query set. An automaton of all its spellings is built once in each Python worker, and a text is
    read once, whatever the number of spellings. What is broadcast is their list, of ``limit`` spellings at most; a larger
    catalog is read in so many blocks, and the texts as often.
    """
    strong = F.col("requires_strong_signal") if "requires_strong_signal" in catalog.columns else F.lit(False)
    s = spellings(catalog).select("canonical", F.lower("spelling").alias("s")).where("s <> ''").distinct()
    s = s.join(catalog.select("canonical", strong.alias("strong")).dropDuplicates(["canonical"]), "canonical")
    n = max(1, -(-s.count() // limit))
    low = spread(docs).withColumn("_low", F.lower(flatten_text(F.col("text"))))
    out = None
    for i in range(n):
        block = s.where(F.pmod(F.xxhash64("canonical"), F.lit(n)) == i).collect()
        brands = brand_finder(docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block]))
        some = low.withColumn("_brand", F.explode(brands("_low"))).drop("_low")
        out = some if out is None else out.unionByName(some)
    return out


def brand_candidates(docs: DataFrame, catalog: DataFrame, limit: int = 500_000) -> DataFrame:
    """(doc_id, canonical) by case-blind containment of any spelling."""
    return with_brands(docs.select("doc_id", "text"), catalog, limit).select("doc_id", "_brand.canonical")


def escaped(c: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


def word_offsets(text: Column, word: Column) -> Column:
    """0-based offsets of a word or phrase with no letter or digit on either side."""
    low, w = F.lower(text), F.lower(word)
    pieces = F.split(F.concat(F.lit(" "), low, F.lit(" ")), escaped(w), -1)
    n = F.greatest(F.size(pieces) - 1, F.lit(0))
    # each hit with the pieces on either side; an empty piece between two hits is an edge as well
    hits = F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), lambda a, b: F.struct(F.length(a).alias("n"), (~a.rlike("[A-Za-z0-9]$") & ~b.rlike("^[A-Za-z0-9]")).alias("ok")))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        at = s["at"] + h["n"]
        return F.struct((at + F.length(w)).alias("at"), F.when(h["ok"], F.concat(s["out"], F.array(at))).otherwise(s["out"]).alias("out"))

    return F.aggregate(hits, start, step)["out"]


def brand_occurrences(docs: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Whole-word offsets in the flattened text, distinct by offset over spellings."""
    found = with_brands(docs.select("doc_id", "text"), catalog).select("doc_id", "_brand.canonical", "_brand.at")
    return found.join(candidates, ["doc_id", "canonical"], "left_semi").select("doc_id", "canonical", F.explode("at").alias("at"))


def is_person(flat: Column, at: Column) -> Column:
    """Whether an honorific or role stands one word or two ahead of an offset."""
    before = F.substring(flat, F.greatest(F.lit(1), at - 39), F.least(F.lit(40), at))
    words = F.filter(F.split(F.lower(before), "[^a-z]+"), lambda w: w != "")
    last_two = F.when(F.size(words) > 2, F.slice(words, -2, 2)).otherwise(words)
    return F.arrays_overlap(last_two, F.array(*map(F.lit, PERSON)))


def drop_person_contexts(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Without hits that an honorific or role precedes by one word or two."""
    flat = docs.select("doc_id", flatten_text(F.col("text")).alias("flat"))
    return occurrences.join(flat, "doc_id").where(~is_person(F.col("flat"), F.col("at"))).select("doc_id", "canonical", "at")


def model_proximity(docs: DataFrame, occurrences: DataFrame, hints: DataFrame) -> DataFrame:
    """Whether a model hint (3 characters or more) stands within 800, and within 20, characters."""
    flat = docs.select("doc_id", flatten_text(F.col("text")).alias("flat"))
    h = hints.where(F.length("hint") >= 3).join(flat, "doc_id").select("doc_id", F.array_sort(word_offsets(F.col("flat"), F.col("hint"))).alias("h"))
    o = occurrences.groupBy("doc_id", "canonical").agg(F.collect_list("at").alias("at"))
    near = lambda d: F.coalesce(is_near(F.col("at"), F.col("h"), d), F.lit(False))
    return o.join(h, "doc_id", "left").select("doc_id", "canonical", near(799).alias("co_occurs"), near(20).alias("adjacent"))


def is_near(a: Column, b: Column, distance: int) -> Column:
    """Whether some offset of a and one of b are at most ``distance`` apart: both are merged in
    order, and neighbours of different kinds compared."""
    tag = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(k).alias("k")))
    both = F.array_sort(F.concat(tag(a, 0), tag(b, 1)))
    ahead = F.slice(both, F.lit(2), F.greatest(F.size(both) - 1, F.lit(0)))
    return F.exists(F.arrays_zip(both.alias("p"), ahead.alias("q")), lambda z: F.coalesce((z["p"]["k"] != z["q"]["k"]) & (z["q"]["x"] - z["p"]["x"] <= distance), F.lit(False)))


def self_identification(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates, and whether the text names one of their spellings as its own product."""
    return with_brands(docs.select("doc_id", "text"), catalog).select("doc_id", "_brand.canonical", F.col("_brand.itself").alias("self_identifies"))


def padded_words(c: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def exclude_self_reference(scored: DataFrame, titles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Drop a brand whose only mention stands inside the title's words, by any of its spellings."""
    t = titles.select("doc_id", padded_words(F.col("title")).alias("_t"))
    s = spellings(catalog).groupBy("canonical").agg(F.collect_set("spelling").alias("_s"))
    inside = F.exists("_s", lambda x: (padded_words(x) != "  ") & F.contains(F.col("_t"), padded_words(x)))
    return scored.join(t, "doc_id", "left").join(s, "canonical", "left").where(F.coalesce(~(inside & (F.col("hits") <= 1)), F.lit(True))).drop("_t", "_s")


def score_brands(docs: DataFrame, catalog: DataFrame, hint: Column) -> DataFrame:
    """Hits, +1 for an early one, +1 near a model hint, +20 for self-identification; brands that need
    a strong signal must identify themselves. ``hint`` is a column of ``docs``; all in a row's own text."""
    d = docs.select("doc_id", "text", hint.alias("_hint"), boundary_of(F.col("text")).alias("_early"), flatten_text(F.col("text")).alias("_flat"))
    b = with_brands(d, catalog).drop("text")
    flat = F.col("_flat")
    b = b.withColumn("_self", F.col("_brand.itself")).where("size(_brand.at) > 0 and (_self or not _brand.strong)")
    b = b.withColumn("_at", F.filter("_brand.at", lambda at: ~is_person(flat, at))).where(F.size("_at") > 0)
    b = b.withColumn("_h", F.when(F.length("_hint") >= 3, word_offsets(flat, F.col("_hint"))))
    near = lambda n: F.coalesce(is_near(F.col("_at"), F.col("_h"), n), F.lit(False))
    s = b.select("doc_id", "_brand.canonical", F.size("_at").cast("long").alias("hits"), F.exists("_at", lambda x: x < F.col("_early")).alias("early"), near(799).alias("co_occurs"), near(20).alias("adjacent"), F.col("_self").alias("self_identifies"))
    n = lambda c: F.col(c).cast("int")
    return s.withColumn("score", F.col("hits") + n("early") + n("co_occurs") + 20 * n("self_identifies"))


def pick_brand(scored: DataFrame) -> DataFrame:
    """The top score (ties by name); then it must identify itself, or be adjacent with 2 hits, or
    have 6 hits. A winner that fails leaves the document without a brand."""
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "canonical")
    top = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return top.where("self_identifies or (adjacent and hits >= 2) or hits >= 6")


def known_brand_override(docs: DataFrame, priority: DataFrame, picked: DataFrame) -> DataFrame:
    """A priority list (rank, canonical, pattern, min_hits) is checked first, else the pick stands."""
    rows = priority.orderBy("rank").collect()  # a short fixed list
    found = F.array_compact(F.array(*[F.when(F.regexp_count("text", F.lit(ascii_edges(r.pattern))) >= r.min_hits, F.lit(r.canonical)) for r in rows]))
    known = docs.select("doc_id", F.get(found, F.lit(0)).alias("known"))
    return known.join(picked.select("doc_id", "canonical"), "doc_id", "left").select("doc_id", F.coalesce("known", "canonical").alias("brand"), F.col("known").isNotNull().alias("is_known"))


def identity_confidence(df: DataFrame) -> DataFrame:
    """Mean of maker and model confidence, capped where the model is the file's name or there is
    no brand. Columns: is_known, brand, hits, early, co_occurs, model_source."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    brand = F.when(F.col("is_known"), 0.95).when(F.col("brand").isNotNull(), F.least(F.lit(0.85), 0.5 + 0.1 * F.least(n("hits"), F.lit(3.0)) + 0.1 * n("early") + 0.15 * n("co_occurs"))).otherwise(0.15)
    model = F.when(F.col("model_source") == "title", 0.9).when(F.col("model_source") == "file", 0.35).otherwise(0.15)
    mean = (brand + model) / 2
    mean = F.when(F.col("model_source") == "file", F.least(mean, F.lit(0.45))).otherwise(mean)
    mean = F.when(F.col("brand").isNull(), F.least(mean, F.lit(0.35))).otherwise(mean)
    return df.withColumn("identity_confidence", F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.05), mean)), 4))


def model_sources(docs: DataFrame) -> Column:
    """(source, model) of every source that gives one, in order."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    e = lambda c, p: F.nullif(F.trim(F.regexp_extract(c, ascii_edges(p), 1)), F.lit(""))
    cover = F.element_at(F.split("text", r"(?m)^=== PAGE (?!1 ===)[0-9]+ ==="), 1)
    above = e(cover, rf"(?im)^[ \t]*(?!===)([^\n]{{3,70}}?)[ \t]*\n[ \t]*{KIND}(?:[ \t]+(?:rev\.?|revision)[ \t]*[A-Z0-9.]+)?[ \t]*$")
    # words right ahead of the document's kind, in any case: the first that can be a name
    words = F.regexp_extract_all(flatten_text(cover), F.lit(ascii_edges(rf"(?i)\b([A-Z][A-Za-z0-9_-]{{2,30}})[™®]?\s+{KIND}\b")), F.lit(1))
    named = lambda w: ~F.lower(w).isin(*STOPWORDS) & (w.rlike("^[A-Z]") | w.rlike("[0-9]")) & is_title(w)
    sources = [("line", e(F.col("text"), r"(?i)product(?: line)?: *([A-Za-z0-9 ]{3,40})")), ("number", e(F.col("text"), r"(?i)model: *([A-Za-z0-9-]{2,20})")), ("title", e(first, TITLE)), ("two_line", F.when(is_title(above), above)), ("spaced", F.nullif(F.regexp_replace(e(first, r"^((?:[A-Z] ){3,}[A-Z])\b"), " ", ""), F.lit(""))), ("cover", F.get(F.filter(words, named), F.lit(0)))]
    # each is named once: whatever is named twice here is searched for twice
    return F.filter(F.array(*[F.struct(F.lit(n).alias("source"), c.alias("model")) for n, c in sources]), lambda m: m["model"].isNotNull())


def model_candidates(docs: DataFrame) -> DataFrame:
    """Model names by ordered sources; the first source that gives one wins."""
    return docs.select("doc_id", F.get(model_sources(docs), F.lit(0)).alias("m")).where("m is not null").select("doc_id", "m.source", "m.model")


def stated_model(docs: DataFrame) -> Column:
    """(source, model) of the first source whose model can stand: titles must pass the title filters."""
    return F.get(F.filter(model_sources(docs), lambda m: m["source"].isin("line", "number") | is_title(m["model"])), F.lit(0))


def titles(docs: DataFrame) -> DataFrame:
    """(doc_id, title) of the manuals whose first line is a title."""
    return docs.select("doc_id", F.nullif(F.regexp_extract(F.get(F.split("text", "\n"), F.lit(0)), TITLE, 1), F.lit("")).alias("title")).where("title is not null")


def is_title(c: Column) -> Column:
    """Not page furniture, a data line (copyright, dot leaders, dates, colon, three numbers) or
    words of the document's kind alone."""
    data = c.rlike(r"(?i)copyright|©|\.{4,}|[0-9]{4}-[0-9]{2}|:|([0-9]+[^0-9]+){3,}")
    furniture = c.rlike(ascii_edges(r"(?i)^(page|rev|contents?|user manual)\b"))
    only = F.regexp_replace(F.lower(c), ascii_edges(rf"\b({'|'.join(DOC_WORDS)})\b"), "")
    return ~data & ~furniture & only.rlike("[a-z]{2,}")


def without_brand(title: Column, brand: Column) -> Column:
    lead = F.lower(title).startswith(F.concat(F.lower(brand), F.lit(" ")))
    return F.when(lead, F.substring(title, F.length(brand) + 2, F.length(title))).otherwise(title)


def title_filters(candidates: DataFrame, brands: DataFrame) -> DataFrame:
    """Acceptable titles, without a leading brand name."""
    b = candidates.where(is_title(F.col("title"))).join(brands, "doc_id", "left")
    return b.select("doc_id", without_brand(F.col("title"), F.col("brand")).alias("title"))


def file_model(name: Column) -> Column:
    """The file name without extension, hash prefix, document words, revision and date; the first
    token of letters and digits, else what remains; a pure hash gives null."""
    c = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    c = F.regexp_replace(c, r"^[0-9a-f]{16,}[_-]?", "")
    c = F.regexp_replace(c, "[_ -]+", " ")
    c = F.regexp_replace(c, ascii_edges(rf"(?i)\b({'|'.join(DOC_WORDS)})[0-9.]*\b"), " ")
    c = F.regexp_replace(c, ascii_edges(r"\b(19|20)[0-9]{6}\b"), " ")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    token = F.regexp_extract(c, ascii_edges(r"\b([A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z][A-Za-z0-9]*)\b"), 1)
    return F.nullif(F.when(token != "", token).otherwise(c), F.lit(""))


def model_from_filename(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", file_model(F.col("source_name")).alias("model"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def corroborated(text: Column, model: Column) -> Column:
    """(model, exact): the pick if its folded form stands in the words after the cover line; else the
    closest run of one more or one fewer word of the cover that shares a folded word with it, is more
    than 0.8 similar and holds a digit; earlier runs win ties.

    Only runs around a shared word are made, from words that were cut and folded once: a cover may be a whole text.
    """
    parts = F.split(text, "\n", 2)
    cover = F.filter(F.split(F.get(parts, F.lit(0)), r"\s+"), lambda w: w != "")
    body = ocr_fold(F.get(parts, F.lit(1)))
    words = F.split(model, r"\s+")

    def closest(v: Column) -> Column:
        n_words, k = F.size(v["cover"]), F.size(v["mine"])
        shared = F.filter(F.transform(v["cover"], lambda w, i: F.when(F.array_contains(v["mine"], ocr_fold(w)), i)), lambda i: i.isNotNull())
        starts = lambda p, n: F.sequence(F.greatest(F.lit(0), p - n + 1), F.least(p, F.greatest(n_words - n, F.lit(0))))
        sizes = F.sequence(F.greatest(F.lit(1), k - 1), k + 1)
        runs = F.array_distinct(F.flatten(F.transform(shared, lambda p: F.flatten(F.transform(sizes, lambda n: F.transform(starts(p, n), lambda i: F.struct(i.alias("i"), n.alias("n"))))))))
        grams = F.transform(runs, lambda r: F.struct(r["i"].alias("i"), F.array_join(F.slice(v["cover"], r["i"] + 1, r["n"]), " ").alias("g")))
        fit = F.filter(grams, lambda x: x["g"].rlike("[0-9]") & ~x["g"].rlike(RANGE))
        best = F.array_min(F.transform(fit, lambda x: F.struct((-F.coalesce(edit_similarity(ocr_fold(x["g"]), v["folded"]), F.lit(-1.0))).alias("far"), x["i"].alias("i"), x["g"].alias("g"))))
        return let(best, lambda x: F.when(x["far"] < -0.8, x["g"]))

    known = F.struct(cover.alias("cover"), ocr_fold(model).alias("folded"), F.transform(words, lambda w: ocr_fold(w)).alias("mine"))
    exact = F.contains(body, ocr_fold(model)) & (F.length(ocr_fold(model)) >= 3)
    return let(exact, lambda e: F.struct(F.when(e, model).otherwise(let(known, closest)).alias("model"), e.alias("exact")))


def corroborate_model(docs: DataFrame, picks: DataFrame) -> DataFrame:
    c = docs.join(picks, "doc_id").select("doc_id", corroborated(F.col("text"), F.col("model")).alias("c"))
    return c.select("doc_id", "c.model", "c.exact")


def fixture_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("fixture_id", slug(F.col("manufacturer"), F.col("model")))


def resolve_identity(docs: DataFrame, catalog: DataFrame, priority: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All of the above as one row for each document, with placeholders and flags.

    The model is the manual's own (a title as the body spells it and without the brand), else
    the file name's; brands whose only mention is in the model's words are no candidates. ``keep`` writes a
    step that is read more than once (models with their texts, scores), so that no text is searched again.
    """
    text = F.col("text")

    def named(m: Column) -> Column:
        title = F.when(~m["source"].isin("line", "number"), let(m["model"], lambda x: F.coalesce(corroborated(text, x)["model"], x)))
        return let(title, lambda x: F.struct(x.alias("title"), F.when(m["source"].isin("line", "number"), m["model"]).otherwise(x).alias("model")))

    d = keep(spread(docs).select("doc_id", "text", let(stated_model(docs), named).alias("_m"), file_model(F.col("source_name")).alias("_file")))
    d = d.select("doc_id", "text", F.col("_m.title").alias("_title"), F.col("_m.model").alias("_model"), "_file")
    scored = score_brands(d, catalog, F.coalesce("_model", "_file"))
    scored = keep(exclude_self_reference(scored, d.select("doc_id", F.col("_model").alias("title")).where("title is not null"), catalog))
    brand = known_brand_override(d, priority, pick_brand(scored))
    facts = brand.join(scored.select("doc_id", F.col("canonical").alias("brand"), "hits", "early", "co_occurs"), ["doc_id", "brand"], "left")

    m = d.select("doc_id", "_model", "_title", "_file").join(facts, "doc_id", "left").na.fill(False, ["is_known"])
    bare = F.when(is_title(F.col("_title")), without_brand(F.col("_title"), F.col("brand")))
    m = m.withColumn("model", F.coalesce(bare, "_model", "_file")).withColumn("model_source", F.when(F.col("_model").isNotNull(), "title").when(F.col("_file").isNotNull(), "file").otherwise("none"))
    out = identity_confidence(m)
    out = out.select("doc_id", F.coalesce("brand", F.lit("Unknown maker")).alias("manufacturer"), F.coalesce("model", F.lit("Unknown model")).alias("model"), "identity_confidence", (F.col("model_source") == "title").alias("from_manual"), (F.col("model_source") == "file").alias("filename_echo"))
    return fixture_ids(out)
