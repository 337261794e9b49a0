"""Queries over prose as manuals: identity, components and wheels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.functions import text as tx
from specmine.operators import identity, rows
from specmine.plans.case import Tables, case

CATALOG = [("the", [], False), ("of", ["off"], False), ("and", ["und"], False), ("that", [], True), ("les", ["des"], False)]
SPELL = ", ".join(f"('{c}', '{s}', {str(strong).lower()})" for c, aliases, strong in CATALOG for s in [c, *aliases])
CAT = f"spelt(canonical, spelling, strong) as (values {SPELL})"
FLAT = r"flat as (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat, source_name from manuals)"
CANDS = f"{CAT}, {FLAT}, cands as (select distinct doc_id, canonical from manuals join spelt on contains(lower(text), spelling))"
# whole-word offsets: between the pieces around a spelling; an empty piece is another hit right beside it, so no edge
OCC = CANDS + r""", cuts as (select doc_id, canonical, spelling, string_split(' ' || lower(flat) || ' ', spelling) as p from cands join spelt using (canonical) join flat using (doc_id)),
    sums as (select doc_id, canonical, spelling, p, unnest(range(1, len(p))) as i from cuts where len(p) > 1),
    occ as (select distinct doc_id, canonical, cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(spelling) - 1 as int) as "at" from sums where p[i] <> '' and p[i + 1] <> '' and not regexp_matches(p[i], '[A-Za-z0-9]$') and not regexp_matches(p[i + 1], '^[A-Za-z0-9]'))"""
PERSON = ", ".join(f"'{w}'" for w in identity.PERSON)
KEPT = OCC + rf""", ctx as (select occ.*, list_filter(regexp_split_to_array(lower(substr(flat, greatest(1, "at" - 39), least(40, "at"))), '[^a-z]+'), lambda w: w <> '') as w from occ join flat using (doc_id)),
    kept as (select doc_id, canonical, "at" from ctx where len(list_intersect(case when len(w) > 2 then w[len(w) - 1:] else w end, [{PERSON}])) = 0)"""
BOUND = r"bounds as (select doc_id, length(text) as boundary from manuals)"


def catalog(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(CATALOG, "canonical string, aliases array<string>, requires_strong_signal boolean")


def cands(t: Tables) -> DataFrame:
    return identity.brand_candidates(t("manuals"), catalog(t))


def occ(t: Tables) -> DataFrame:
    return identity.brand_occurrences(t("manuals"), cands(t), catalog(t))


def kept(t: Tables) -> DataFrame:
    return identity.drop_person_contexts(t("manuals"), occ(t))


def hints(t: Tables) -> DataFrame:
    return t("manuals").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "with").otherwise("from").alias("hint"))


def scored(t: Tables) -> DataFrame:
    return identity.score_brands(t("manuals"), catalog(t), F.when(F.col("doc_id") % 2 == 0, "with").otherwise("from"))


PROX = KEPT + r""", hint as (select doc_id, case when doc_id % 2 = 0 then 'with' else 'from' end as hint from manuals), hcuts as (select doc_id, hint as spelling, string_split(' ' || lower(flat) || ' ', hint) as p from hint join flat using (doc_id)), hsums as (select doc_id, spelling, p, unnest(range(1, len(p))) as i from hcuts where len(p) > 1),
    hocc as (select distinct doc_id, cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(spelling) - 1 as int) as h from hsums where not regexp_matches(p[i], '[A-Za-z0-9]$') and not regexp_matches(p[i + 1], '^[A-Za-z0-9]')),
    near as (select k.doc_id, canonical, bool_or(abs(h - "at") <= 20) as adjacent from kept k join hocc using (doc_id) where abs(h - "at") < 800 group by 1, 2),
    prox as (select e.doc_id, e.canonical, n.adjacent is not null as co_occurs, coalesce(n.adjacent, false) as adjacent from (select distinct doc_id, canonical from occ_all) e left join near n using (doc_id, canonical))"""
PROX = PROX.replace("occ_all", "kept")
SELF = r"selfs as (select doc_id, canonical, bool_or(regexp_matches(flat, '(?i)(purchasing|buying) this\s+' || spelling || '\b|\bthis\s+' || spelling || '\s+product\b')) as self_identifies from cands join spelt using (canonical) join flat using (doc_id) group by 1, 2)"
SCORED = f"""{PROX}, {SELF}, {BOUND}, o as (select doc_id, canonical, count(*) as hits, bool_or("at" < boundary) as early from kept join bounds using (doc_id) group by 1, 2),
    scored as (select doc_id, canonical, hits, early, coalesce(co_occurs, false) as co_occurs, coalesce(adjacent, false) as adjacent, coalesce(self_identifies, false) as self_identifies, hits + cast(early as int) + cast(coalesce(co_occurs, false) as int) + 20 * cast(coalesce(self_identifies, false) as int) as score from o left join prox using (doc_id, canonical) left join selfs using (doc_id, canonical) where coalesce(self_identifies, false) or canonical <> 'that')"""
PICK = SCORED + ", picked as (select doc_id, canonical, hits, early, co_occurs, adjacent, self_identifies, score from (select *, row_number() over (partition by doc_id order by score desc, canonical) as r from scored) where r = 1 and (self_identifies or (adjacent and hits >= 2) or hits >= 6))"

case("i1_flatten_text", lambda t: t("manuals").select("doc_id", tx.flatten_text(F.col("text")).alias("flat")), "manuals", f"{FLAT} select doc_id, flat from flat")
case("i2_early_boundary", lambda t: identity.early_boundary(t("manuals").withColumn("text", F.regexp_replace("text", "\n", "\n=== PAGE 1 ===\n"))), "manuals", r"""x as (select doc_id, replace(text, chr(10), chr(10) || '=== PAGE 1 ===' || chr(10)) as text from manuals), y as (select doc_id, text, string_split(text, '=== PAGE 1 ===') as p from x)
    select doc_id, cast(case when len(p) >= 4 then length(p[1]) + length(p[2]) + length(p[3]) + 28 else length(text) end as int) as boundary from y""")  # fmt: skip
case("i3_brand_candidates", cands, "manuals", f"{CANDS} select * from cands")
case("i4_brand_occurrences", occ, "manuals", f"{OCC} select * from occ")
case("i5_drop_person_contexts", kept, "manuals", f"{KEPT} select * from kept")
case("i6_model_proximity", lambda t: identity.model_proximity(t("manuals"), kept(t), hints(t)), "manuals", f"{PROX} select * from prox")
case("i7_self_identification", lambda t: identity.self_identification(t("manuals"), catalog(t)), "manuals", f"{CANDS}, {SELF} select * from selfs")
case("i8_exclude_self_reference", lambda t: identity.exclude_self_reference(scored(t), t("manuals").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title")), catalog(t)).select("doc_id", "canonical", "hits"), "manuals", rf"{SCORED} select doc_id, canonical, hits from scored join manuals using (doc_id) where not (hits = 1 and exists (select 1 from spelt where spelt.canonical = scored.canonical and contains(' ' || trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || spelling || ' ')))")
COVER = "regexp_extract(string_split(text, chr(10))[1], '^([A-Z][A-Za-z0-9]+(?: [A-Z0-9][A-Za-z0-9]*)+)', 1)"
case("i8_exclude_self_reference_titles", lambda t: identity.exclude_self_reference(scored(t), identity.titles(t("manuals")), catalog(t)).select("doc_id", "canonical", "hits"), "manuals", rf"{SCORED} select doc_id, canonical, hits from scored join manuals using (doc_id) where not (hits = 1 and exists (select 1 from spelt where spelt.canonical = scored.canonical and contains(' ' || trim(regexp_replace(lower({COVER}), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || spelling || ' ')))")
case("i9_score_brands", scored, "manuals", f"{SCORED} select * from scored")
case("i10_pick_brand", lambda t: identity.pick_brand(scored(t)), "manuals", f"{PICK} select * from picked")


def priority(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "ACME", "(?i)license", 1), (2, "BETA", r"\bwhen\b", 2), (3, "Gamma", r"\bvon\b", 2)], "rank int, canonical string, pattern string, min_hits int")


KNOWN = PICK + r", known as (select doc_id, case when regexp_matches(text, '(?i)license') then 'ACME' when len(regexp_extract_all(text, '\bwhen\b')) >= 2 then 'BETA' when len(regexp_extract_all(text, '\bvon\b')) >= 2 then 'Gamma' end as k from manuals), brand as (select doc_id, coalesce(k, canonical) as brand, k is not null as is_known from known left join picked using (doc_id))"
case("i11_known_brand_override", lambda t: identity.known_brand_override(t("manuals"), priority(t), identity.pick_brand(scored(t))), "manuals", f"{KNOWN} select * from brand")
CONF = """round(least(0.97, greatest(0.05, case when brand is null then least(0.35, m2) else m2 end)), 4)"""
case(
    "i12_identity_confidence",
    lambda t: identity.identity_confidence(t("manuals").select("doc_id", (F.col("doc_id") % 5 == 0).alias("is_known"), F.when(F.col("doc_id") % 3 > 0, "x").alias("brand"), (F.col("doc_id") % 7).alias("hits"), (F.col("doc_id") % 2 == 0).alias("early"), (F.col("doc_id") % 4 == 0).alias("co_occurs"), F.element_at(F.array(F.lit("title"), F.lit("file"), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int")).alias("model_source"))).select("doc_id", "identity_confidence"),
    "manuals",
    f"""x as (select doc_id, case when doc_id % 3 > 0 then 'x' end as brand, case when doc_id % 5 = 0 then 0.95 when doc_id % 3 > 0 then least(0.85, 0.5 + 0.1 * least(doc_id % 7, 3) + case when doc_id % 2 = 0 then 0.1 else 0 end + case when doc_id % 4 = 0 then 0.15 else 0 end) else 0.15 end as b, case doc_id % 3 when 0 then 0.9 when 1 then 0.35 else 0.15 end as m from manuals),
    y as (select doc_id, brand, case when doc_id % 3 = 1 then least(0.45, cast(b + m as double) / 2) else cast(b + m as double) / 2 end as m2 from x) select doc_id, cast({CONF} as double) as identity_confidence from y""",
)
LEADS = "case doc_id % 6 when 0 then concat('Lumabeam', chr(10), 'User Manual', chr(10)) when 1 then concat('W A S H E R', chr(10)) when 2 then 'please read this user manual and the SPIKIE-7 owner''s manual, ' when 3 then concat('Product line: Aura XB', chr(10)) when 4 then concat('cover', chr(10), 'Model: MHX-250', chr(10)) else '' end"


def led(t: Tables) -> DataFrame:
    """Manuals that begin with a statement of the model, of each kind."""
    return t("manuals").withColumn("text", F.expr(f"concat({LEADS}, text)"))


STOP = ", ".join(f"'{w}'" for w in identity.STOPWORDS)
SUFFIX = identity.KIND.replace("'", "''")
DOC_WORD = r"\b(" + "|".join(identity.DOC_WORDS) + r")\b"
TITLED = r"(not regexp_matches({0}, '(?i)copyright|©|\.{{4,}}|[0-9]{{4}}-[0-9]{{2}}|:|([0-9]+[^0-9]+){{3,}}') and not regexp_matches({0}, '(?i)^(page|rev|contents?|user manual)\b') and regexp_matches(regexp_replace(lower({0}), '" + DOC_WORD + r"', '', 'g'), '[a-z]{{2,}}'))"
case("i13_model_candidates", lambda t: identity.model_candidates(led(t)), "manuals", rf"""led as (select doc_id, concat({LEADS}, text) as text from manuals), x as (select doc_id, text, string_split(text, chr(10))[1] as first from led),
    y as (select doc_id, nullif(trim(regexp_extract(text, '(?i)product(?: line)?: *([A-Za-z0-9 ]{{3,40}})', 1)), '') as s1, nullif(trim(regexp_extract(text, '(?i)model: *([A-Za-z0-9-]{{2,20}})', 1)), '') as s2, nullif(trim(regexp_extract(first, '{identity.TITLE}', 1)), '') as s3,
      nullif(trim(regexp_extract(text, '(?im)^[ \t]*([^\n]{{3,70}}?)[ \t]*\n[ \t]*{SUFFIX}(?:[ \t]+(?:rev\.?|revision)[ \t]*[A-Z0-9.]+)?[ \t]*$', 1)), '') as s4, nullif(replace(trim(regexp_extract(first, '^((?:[A-Z] ){{3,}}[A-Z])\b', 1)), ' ', ''), '') as s5,
      list_filter(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)\b([A-Z][A-Za-z0-9_-]{{2,30}})[™®]?\s+{SUFFIX}\b', 1), lambda w: lower(w) not in ({STOP}) and regexp_matches(w, '^[A-Z]|[0-9]') and {TITLED.format('w')})[1] as s6 from x)
    select doc_id, case when s1 is not null then 'line' when s2 is not null then 'number' when s3 is not null then 'title' when {TITLED.format('s4')} then 'two_line' when s5 is not null then 'spaced' else 'cover' end as source,
      coalesce(s1, s2, s3, case when {TITLED.format('s4')} then s4 end, s5, s6) as model from y where coalesce(s1, s2, s3, case when {TITLED.format('s4')} then s4 end, s5, s6) is not null""")  # fmt: skip
case("i14_title_filters", lambda t: identity.title_filters(t("manuals").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title")), t("manuals").select("doc_id", F.lit("the").alias("brand"))), "manuals", r"""x as (select doc_id, string_split(text, chr(10))[1] as title from manuals)
    select doc_id, case when starts_with(lower(title), 'the ') then substr(title, 5) else title end as title from x where not regexp_matches(title, '(?i)copyright|©|\.{4,}|[0-9]{4}-[0-9]{2}|:|([0-9]+[^0-9]+){3,}') and not regexp_matches(title, '(?i)^(page|rev|contents?|user manual)\b') and regexp_matches(regexp_replace(lower(title), '\b(manual|user|guide|dmx|chart|instructions|quick|start|rev|version)\b', '', 'g'), '[a-z]{2,}')""")  # fmt: skip
case("i14_title_filters_lines", lambda t: identity.title_filters(t("manuals").select("doc_id", F.explode(F.split("text", "\n")).alias("title")), t("manuals").select("doc_id", F.lit("the").alias("brand"))), "manuals", r"""x as (select doc_id, unnest(string_split(text, chr(10))) as title from manuals)
    select doc_id, case when starts_with(lower(title), 'the ') then substr(title, 5) else title end as title from x where not regexp_matches(title, '(?i)copyright|©|\.{4,}|[0-9]{4}-[0-9]{2}|:|([0-9]+[^0-9]+){3,}') and not regexp_matches(title, '(?i)^(page|rev|contents?|user manual)\b') and regexp_matches(regexp_replace(lower(title), '\b(manual|user|guide|dmx|chart|instructions|quick|start|rev|version)\b', '', 'g'), '[a-z]{2,}')""")  # fmt: skip
case("i15_model_from_filename", lambda t: identity.model_from_filename(t("manuals")), "manuals", r"""x as (select doc_id, regexp_replace(regexp_replace(regexp_replace(source_name, '\.[A-Za-z0-9]+$', ''), '^[0-9a-f]{16,}[_-]?', ''), '[_ -]+', ' ', 'g') as c from manuals),
    y as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(c, '(?i)\b(manual|user|guide|dmx|chart|instructions|quick|start|rev|version)[0-9.]*\b', ' ', 'g'), '\b(19|20)[0-9]{6}\b', ' ', 'g'), '\s+', ' ', 'g')) as c from x)
    select doc_id, nullif(case when regexp_extract(c, '\b([A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z][A-Za-z0-9]*)\b', 1) <> '' then regexp_extract(c, '\b([A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z][A-Za-z0-9]*)\b', 1) else c end, '') as model from y""")  # fmt: skip
FOLD = "regexp_replace(translate(lower({0}), 'il|!oszb', '11110528'), '[^a-z0-9]', '', 'g')"
case("i16_ocr_fold", lambda t: t("manuals").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", "line", tx.ocr_fold(F.col("text")).alias("folded")), "manuals", f"x as (select doc_id, string_split(text, chr(10)) as l from manuals), y as (select doc_id, unnest(range(len(l))) as line, unnest(l) as text from x) select doc_id, cast(line as int) as line, {FOLD.format('text')} as folded from y")
case("i16_ocr_fold_whole", lambda t: t("manuals").select("doc_id", tx.ocr_fold(F.col("text")).alias("folded")), "manuals", f"select doc_id, {FOLD.format('text')} as folded from manuals")
case("i17_corroborate_model", lambda t: identity.corroborate_model(t("manuals").withColumn("text", F.concat(F.lit("Wash 300X manual\n"), "text")), t("manuals").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Wash 3OOX").otherwise("the").alias("model"))), "manuals", f"select doc_id, case when doc_id % 2 = 0 then case when contains({FOLD.format('text')}, 'wa5h300x') then 'Wash 3OOX' else 'Wash 300X' end when contains({FOLD.format('text')}, 'the') then 'the' end as model, case when doc_id % 2 = 0 then contains({FOLD.format('text')}, 'wa5h300x') else contains({FOLD.format('text')}, 'the') end as exact from manuals")
case("i18_edit_similarity", lambda t: t("makers").select("pk", tx.edit_similarity(F.col("maker"), F.col("model")).alias("sim")), "makers", "select pk, 1 - levenshtein(maker, model) / greatest(length(maker), length(model)) as sim from makers")
case("i19_fixture_ids", lambda t: identity.fixture_ids(t("fixtures")).select("doc_id", "fixture_id"), "fixtures", "select doc_id, regexp_replace(regexp_replace(lower(manufacturer || '-' || model), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as fixture_id from fixtures")
case("i20_resolve_identity", lambda t: identity.resolve_identity(t("manuals"), catalog(t), priority(t), t.written))

# ---- components and wheels

def components_sql(source: str, components: list[tuple[str, str]] = rows.COMPONENTS) -> str:
    """``found`` (doc_id, component) over a table (doc_id, text)."""
    cases = [f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in components]
    cases += [f"case when regexp_matches(text, '(?i)(pan\\s+fine|tilt\\s+fine|[xy][ -]?axis\\s+fine|16[ -]?bit(?:\\s+precision)?\\s+scan)') and regexp_matches(text, '(?i)\\b{n}\\b') then '{n} fine' end" for n in ("Pan", "Tilt")]
    cases += [f"case when not regexp_matches(text, '(?i)color wheel') and contains(sign, '{x}') then '{n}' end" for n, x in (("Red", "RGB"), ("Green", "RGB"), ("Blue", "RGB"), ("White", "W"), ("Amber", "A"), ("UV", "UV"))]
    return f"""scanned as (select doc_id, text, regexp_extract(upper(regexp_replace(text, '[^a-z0-9]+', '', 'g')), 'RGB(?:W)?(?:A)?(?:UV)?') as sign from (select doc_id, regexp_replace(text, '\\s+', ' ', 'g') as text from {source})),
    found as (select * from (select doc_id, unnest([{', '.join(cases)}]) as component from scanned) where component is not null)"""


SCANNED = [*rows.COMPONENTS, ("in", r"\bin\b"), ("of", r"\bof\b")]  # the prose holds no controls: two words of its own, and a line of controls for some
CONTROLS = "case doc_id % 7 when 0 then ' Pan, tilt and X/Y speed, pan  fine' when 1 then ' Dimming, colour; gobo wheel, 16 bit precision scan' when 2 then ' STROBE and Prism, a reserved channel, rgbw' when 3 then ' RGB and rgb a uv led' when 4 then ' rgbwa color wheel' when 5 then ' tilt with y-axis fine, rgb uv' else '' end"
case("r35_component_scan", lambda t: rows.component_scan(t("manuals").withColumn("text", F.expr(f"concat(text, {CONTROLS})")), SCANNED), "manuals", f"with_controls as (select doc_id, concat(text, {CONTROLS}) as text from manuals), {components_sql('with_controls', SCANNED)} select doc_id, component from found")


def wheel_docs(t: Tables) -> DataFrame:
    return t("base").where("r = 1").select("doc_id", F.concat((F.col("pk") % 9).cast("string"), F.lit(" gobos and "), (F.col("sk") % 12).cast("string"), F.lit(" colors")).alias("text"))


case("r31_wheel_slots", lambda t: rows.wheel_slots(wheel_docs(t), t("channels")), "base channels", """k as (select doc_id, 'goboWheel' as kind, pk % 9 as n from base where r = 1 union all select doc_id, 'colorWheel', sk % 12 from base where r = 1), s as (select doc_id, kind, unnest(range(1, n + 1)) as slot from k where n between 2 and 64)
    select doc_id, channel_id, channel_id || '-' || kind as wheel_id, cast(slot as int) as slot, 'Slot ' || slot as name from channels join s using (doc_id, kind)""")  # fmt: skip
