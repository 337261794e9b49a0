"""Operators on inline rows: cases of layout, mining, identity, evaluation and streams."""

import datetime
import json
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from specmine.functions import channels as ch
from specmine.functions import text as tx
from specmine.operators import evaluate, identity, layout, lookup, modes, pages, rows, validate
from specmine.plans.bind import bound
from specmine.sources import manuals, records
from specmine.sources.files import through_files
from specmine.streaming import control, live


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x


CLASSES = {
    "Pan MSB": ("Pan", "pan", "", ""),
    "Pan LSB": ("Pan fine", "pan", "", "pan"),
    "Tilt 2 16-bit": ("Tilt 2 fine", "tilt", "", "tilt:2"),
    "Pan/Tilt movement speed": ("Pan / tilt speed", "speed", "", ""),
    "Master dimmer": ("Dimmer", "intensity", "", ""),
    "Red 3": ("Red 3", "colorIntensity", "RED", ""),
    "UV fine": ("UV fine", "colorIntensity", "UV", "colorIntensity:UV:"),
    "Shutter": ("Shutter / strobe", "strobe", "", ""),
    "Colour wheel": ("Color wheel", "colorWheel", "", ""),
    "Lamp on": ("Reset / function", "maintenance", "", ""),
    "something else": ("something else", "generic", "", ""),
}


def test_classify(spark):
    df = spark.createDataFrame([(k,) for k in CLASSES], "t string").select("t", ch.classify(F.col("t")).alias("c"))
    assert {r.t: tuple(r.c) for r in df.collect()} == CLASSES


@pytest.mark.parametrize("text,want", [("000-255 Red level", (0, 255, "Red level")), ("10 – 20: slow", (10, 20, "slow")), ("30..40", (30, 40, "Full range")), ("200-100 x", None), ("0-300 x", None), ("0-100 % speed", None), ("no range", None)])
def test_parse_range(spark, text, want):
    got = one(spark, tx.parse_range(F.col("t")), t=text)
    assert (got and tuple(got)) == want


def test_wide_ranges_read_as_255(spark):
    assert one(spark, tx.parse_range(F.col("t"), wide=True), t="128-256 x").end == 255


def test_text_functions(spark):
    assert one(spark, tx.normalize_line(F.col("t")), t="|1| 0255  12.40 ") == "1 0-255 12-40"
    assert one(spark, tx.clean_function(F.col("t")), t="- hutter;") == "Shutter"
    assert one(spark, tx.clean_function(F.col("t")), t="Vode table (D) gobo") == "Mode table 1 gobo"
    assert one(spark, tx.ocr_fold(F.col("t")), t="Il|0 sZb") == "1110528"
    assert one(spark, tx.attribute_key(F.col("t")), t="Gobo1 Pos 2") == "gobo 1 pos"
    assert one(spark, tx.attribute_template(F.col("t")), t="Gobo12Pos") == "Gobo(n)Pos"
    assert one(spark, tx.text_score(F.col("a"), F.col("b")), a="robe pointe", b="robe spot") == pytest.approx(1 / 3)
    import uuid

    assert one(spark, tx.stable_uuid(F.col("t")), t="a/b") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a/b"))


def test_pages_round_trip(spark):
    text = "front\n=== PAGE 1 ===\na\nb\n=== PAGE 2 ===\nc"
    docs = spark.createDataFrame([(1, text), (2, "=== PAGE 4 ===\r\nx")], "doc_id int, text string")
    got = [(r.doc_id, r.page, r.text) for r in manuals.split_pages(docs).orderBy("doc_id", "page").collect()]
    assert got == [(1, 0, "front"), (1, 1, "a\nb"), (1, 2, "c"), (2, 4, "x")]
    lines = manuals.split_lines(spark.createDataFrame([(1, 1, "a\r\nb\rc"), (1, 2, "d")], "doc_id int, page int, text string"))
    assert [(r.line_no, r.text) for r in lines.orderBy("line_no").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_manual_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("=== PAGE 1 ===\nhello")
    r = manuals.read_manual_text(spark, str(tmp_path)).collect()
    assert [(x.doc_id, x.source_name, x.text) for x in r] == [("one", "one.pdf", "=== PAGE 1 ===\nhello")]


def test_texts_pass_through_files_some_at_a_time(spark, tmp_path):
    """Each text is a file of its own, all are read back whole, and no more files are there at once than told."""
    texts = {f"{i}.txt": ["", "one", "two\nlines\n", "größe\r\n☃"][i % 4] * (i % 7) for i in range(200)}
    there = []

    def read(path):
        there.append([p.name for p in tmp_path.rglob("*.txt")])
        return manuals.read_manual_text(spark, path)

    rows = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = through_files(rows, f"file://{tmp_path}/new", read, limit=60)
    assert {f"{r.doc_id.split('-')[2]}.txt": r.text for r in got.collect()} == {k: f"{v}\n" for k, v in texts.items()} and got.count() == 200
    assert len(there) == 4 and max(map(len, there)) < 100 and sorted(x.split("-")[2] for x in sum(there, [])) == sorted(texts)
    assert not list(tmp_path.rglob("*.txt"))
    assert through_files(rows.where("false"), f"file://{tmp_path}/none", lambda path: manuals.read_manual_text(spark, path)).count() == 0


FIXTURE = {"id": "f1", "identity": {"manufacturer": "ACME", "model": "Beam"}, "channels": [{"id": "c1", "name": "Red", "ranges": [{"start": 0, "end": 255, "name": "Red"}]}, {"id": "c2", "name": "Dim", "kind": "intensity"}], "modes": [{"id": "m1", "name": "Basic", "channels": [{"channelId": "c1", "offset": 1, "dmxBreak": 1}]}], "unknown": 1}


def test_fixture_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(FIXTURE))
    (tmp_path / "bad.json").write_text("{not json")
    good, bad = records.read_fixtures(spark, str(tmp_path))
    assert [r.file for r in bad.select("file").collect()] == ["bad.json"]
    flat = records.normalize_fixtures(good)
    assert [(r.channel_id, r.kind, r.confidence) for r in flat["channels"].collect()] == [("c1", "generic", 1.0), ("c2", "intensity", 1.0)]
    assert flat["modes"].first().breaks == 1 and flat["assignments"].count() == 1 and flat["wheel_slots"].count() == 0
    records.write_fixture_json(good.select("id"), str(tmp_path / "out"))
    assert json.loads(next(Path(tmp_path / "out").glob("part*")).read_text()) == {"id": "f1"}


def test_taxonomy_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<A><Attribute Name="Dimmer" Pretty="Dim" Feature="Dimmer.Dimmer"/><Attribute Name="X"/></A>')
    got = sorted(map(tuple, records.read_taxonomy_xml(spark, str(tmp_path / "t.xml")).collect()))
    assert got == [("Dimmer", "Dim", "Dimmer.Dimmer"), ("X", "X", "Control.Control")]


def test_scoreboard_csv(spark, tmp_path):
    records.write_scoreboard(spark.createDataFrame([(1, 1 / 3)], "doc_id int, recall double"), str(tmp_path / "b"))
    assert spark.read.csv(str(tmp_path / "b"), header=True).first().recall == "0.3333"


def test_layout_columns(spark):
    items = [(1, "24Ch", 59, 100), (2, "34Ch", 104, 100), (3, "Function", 150, 100), (4, "7", 61, 80), (5, "Pan", 150, 80), (6, "8", 62, 60), (7, "9", 105, 60), (8, "Tilt", 150, 60)]
    df = spark.createDataFrame([(1, 1, n, t, float(x), float(y), 10.0, 8.0) for n, t, x, y in items], "doc_id int, page int, item_no int, text string, x double, y double, width double, height double")
    r = layout.cluster_rows(df)
    assert [x.row_id for x in r.orderBy("item_no").collect()] == [1, 1, 1, 2, 2, 3, 3, 3]
    assert [x.text for x in layout.join_row_text(r).orderBy("row_id").collect()] == ["24Ch   34Ch   Function", "7   Pan", "8   9   Tilt"]
    h = layout.detect_count_headers(r)
    assert [(x.counts, x.centres) for x in h.collect()] == [([24, 34], [64.0, 109.0])]
    cells = layout.snap_cells(r)
    assert [(x.row_id, x.cells) for x in cells.collect()] == [(2, ["7", "-"])]


def test_page_choice(spark):
    df = spark.createDataFrame([(1, 1, "Channel table\n1 Red 0-255", False), (1, 2, "more", False), (1, 3, "far", False), (1, 4, "0-1 2-3 4-5 6-7 8-9", True)], "doc_id int, page int, text string, from_ocr boolean")
    assert sorted(r.page for r in pages.pages_for_detailed_read(df).collect()) == [1, 2, 4]
    failed = spark.createDataFrame([(1, p) for p in (1, 3, 7, 8, 9)], "doc_id int, page int")
    assert pages.page_runs(failed).first().pages == "1, 3 and 7-9"


def test_sequences_and_ranges(spark):
    r = spark.createDataFrame([(1, i, c) for i, c in enumerate([1, 2, 5, 3, 4, 4])], "doc_id int, line_no int, channel int")
    assert sorted(x.line_no for x in rows.accept_in_sequence(r, ["doc_id"]).collect()) == [0, 1, 3, 4]
    g = spark.createDataFrame([(1, "c", i, a, b) for i, (a, b) in enumerate([(0, 100), (50, 60), (101, 255), (10, 5)])], "doc_id int, channel_id string, range_idx int, range_start int, range_end int")
    assert sorted(x.range_idx for x in rows.drop_overlapping_ranges(g).collect()) == [0, 2]
    assert validate.covers_full(g.where("range_idx in (0, 2)")).first().covers
    c = validate.complete_ranges(g.select("doc_id", "channel_id"), g.where("range_idx = 1").withColumn("name", F.lit("n")))
    assert sorted((x.range_start, x.range_end, x.name) for x in c.collect()) == [(0, 49, "Unspecified"), (50, 60, "n"), (61, 255, "Unspecified")]


def test_mode_inheritance_is_transitive(spark):
    m = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 1, 3)], "doc_id int, mode_idx int, parent_idx int, prefix int")
    r = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 3, "c"), (1, 2, 1, "x")], "doc_id int, mode_idx int, position int, channel_id string")
    got = sorted((x.position, x.channel_id) for x in modes.inherit_modes(m, r).where("mode_idx = 2").collect())
    assert got == [(1, "x"), (2, "b"), (3, "c")]


def test_rules_of_a_valid_record(spark):
    fx = spark.createDataFrame([(1, "ACME", "Beam")], "doc_id int, manufacturer string, model string")
    c = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "a")], "doc_id int, channel_idx int, channel_id string, fine_of string")
    g = spark.createDataFrame([(1, "a", 0, 0, 255, "all", "normal", 0.9)], "doc_id int, channel_id string, range_idx int, range_start int, range_end int, name string, safety string, confidence double")
    m = spark.createDataFrame([(1, 0, 1)], "doc_id int, mode_idx int, breaks int")
    pixels = lambda n: spark.createDataFrame([(1, 2, 2, 0, n)], "doc_id int, x int, y int, z int, n_pixels int")
    a = lambda second: spark.createDataFrame([(1, 0, 0, "a", 1, 1), (1, 0, 1, "b", second, 1)], "doc_id int, mode_idx int, slot_idx int, channel_id string, channel_offset int, dmx_break int")
    assert validate.validate(fx, c, g, m, a(2), pixels(4)).count() == 0
    assert [x.code for x in validate.validate(fx, c, g, m, a(1), pixels(5)).collect()] == ["slot.overlap", "matrix.count"]


def test_evaluation_edges(spark):
    t = spark.createDataFrame([(1, 0, 4), (1, 1, 6), (2, 0, 5)], "doc_id int, mode_idx int, footprint bigint")
    e = spark.createDataFrame([(1, 0, 4), (1, 1, 7)], "doc_id int, mode_idx int, footprint bigint")
    rp = {x.doc_id: (x.recall, x.precision) for x in evaluate.footprint_recall_precision(t, e).collect()}
    assert rp == {1: (0.5, 0.5), 2: (0.0, None)}
    assert {x.doc_id: x.recall_tol1 for x in evaluate.recall_tol1(t, e).collect()} == {1: 1.0, 2: 0.0}
    import numpy as np

    assert evaluate.best_of(np.array([[0.9, 0.8], [0.8, 0.1]])) == [(0, 1), (1, 0)]
    wide = np.eye(8)
    assert sorted(evaluate.best_of(wide)) == [(i, i) for i in range(8)]
    r = evaluate.name_ratio(spark.createDataFrame([("Dimmer!", "dimmer"), ("", None)], "a string, b string")).collect()
    assert sorted((x.name_ratio is None, x.name_ratio) for x in r if x.a) == [(False, 1.0)]


def test_scoring_of_slots(spark):
    """Fine bytes by link, attributes whatever the case and only under a name, missing slots as 0."""
    t = spark.createDataFrame([(1, 0, 1, 1, "Pan", "pan ", 3, 0), (1, 0, 1, 2, "Pan", "Pan", 0, 1), (1, 0, 1, 3, "!!", "Tilt", 0, 0), (1, 0, 1, 4, "Zoom", "", 2, 0)], "doc_id int, mode_idx int, dmx_break int, slot int, name string, attribute string, n_functions long, fine int")
    e = spark.createDataFrame([(1, 7, 1, 1, "pan", "PAN", None, 2), (1, 7, 1, 2, "pan fine", None, "", 0), (1, 7, 1, 3, "x", "Tilt", None, 0), (1, 7, 1, 9, "y", None, "c", 0)], "doc_id int, mode_idx int, dmx_break int, slot int, name string, attribute string, fine_of string, n_ranges int")
    (r,) = evaluate.score_pairs(t, e).collect()
    assert (r.footprint, r.truth_mode, r.mode, r.name_n, r.name_sum, r.name_score) == (4, 0, 7, 2, 1.0, 0.5)
    assert (r.fine_hits, r.fine_n, r.attr_hits, r.attr_n, r.rich_hits, r.rich_n) == (0, 1, 1, 1, 1, 2)
    assert evaluate.score_pairs(t, e.where("false")).count() == 0
    import numpy as np

    wide = np.zeros((7, 8))
    wide[0, 3], wide[1, 3], wide[1, 0] = 0.5, 0.9, 0.1
    assert evaluate.best_of(wide)[:2] == [(0, 3), (1, 0)]  # beyond 6 by 6 truth modes choose in turn


def test_names_that_hold_one_another(spark):
    left = spark.createDataFrame([("xbluebolt",), ("led par",), ("par",), ("a b c d",)], "x string")
    right = spark.createDataFrame([("bluebolt",), ("led wash",), ("led par can",), ("a b c",)], "y string")
    got = {(r.x, r.y): round(r.score, 3) for r in lookup.name_pairs(left, right).collect()}
    assert got == {("xbluebolt", "bluebolt"): 0.88, ("led par", "led par can"): 0.88, ("a b c d", "a b c"): 0.88}


def test_nested_footprints(spark):
    df = spark.sql("""select 1L as rid, parse_json('[{"DMXFootprint": 16}, {"a": {"b": {"dmxFootprint": "24"}}}]') as modes""")
    assert sorted(r.footprint for r in lookup.nested_footprints(df).collect()) == [16, 24]


EVENTS = "key string, event_id bigint, ts timestamp, actor string, action string"


def events(spark, steps):
    return spark.createDataFrame([(k, i, None, a, act, float(s)) for i, (k, a, act, s) in enumerate(steps)], "key string, event_id bigint, n int, actor string, action string, s double").select("key", "event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "actor", "action")


def outcomes(df, step):
    return [r.outcome for r in control.fold_batch(df, step).orderBy("event_id").collect()]


def test_steps(spark):
    e = events(spark, [("k", "a", "set", 0), ("k", "b", "set", 1), ("k", "a", "end", 1.25), ("k", "b", "set", 3), ("k", "a", "set", 10)])
    assert outcomes(e, control.lease_gate(1.5)) == ["granted", "conflict", "released", "granted", "granted"]
    e = events(spark, [("k", "a", "x", s) for s in (0, 0, 0, 1, 5)])
    assert outcomes(e, control.token_bucket(2, 0.5)) == ["allow", "allow", "deny", "deny", "allow"]
    assert outcomes(e, control.fixed_window_quota(5, 2)) == ["allow", "allow", "deny", "deny", "allow"]
    e = events(spark, [("k", "a", x, s) for x, s in (("approve", 0), ("request", 1), ("request", 2), ("approve", 3), ("fetch", 4), ("fetch", 5), ("request", 6), ("fetch", 700))])
    assert outcomes(e, control.request_lifecycle(600)) == ["nothing pending (none)", "pending", "replaced", "approved", "served approved", "served", "pending", "expired"]
    e = events(spark, [("k", "a", x, s) for x, s in (("answer", 0), ("offer", 1), ("offer", 2), ("answer", 3), ("answer", 4), ("offer", 5), ("read", 6), ("read", 7), ("offer", 8), ("answer", 400))])
    assert outcomes(e, control.rendezvous(300)) == ["no offer", "offered", "offer replaced", "matched", "second answer", "already answered", "read", "nothing to read", "offered", "no offer"]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_gives_the_batch_result(spark, tmp_path, files):
    steps = [(f"k{i % 3}", f"a{i % 2}", ("set", "end", "set")[i % 3 - 1], i * 0.7) for i in range(60)]
    df = events(spark, steps)
    per = -(-60 // files)
    for i in range(files):  # in order of time
        df.where(f"event_id >= {i * per} and event_id < {(i + 1) * per}").coalesce(1).write.parquet(str(tmp_path / f"in/{i:02d}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = f"folded{files}"
    q = control.fold_stream(source, control.lease_gate(2.0), watermark="1 minute", idle_seconds=3600).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.event_id, r.outcome) for r in spark.table(name).collect())
    assert got == sorted((r.event_id, r.outcome) for r in control.fold_batch(df, control.lease_gate(2.0)).collect())


def test_offers_meet_answers_in_a_stream(spark, tmp_path):
    df = events(spark, [("a", "x", "offer", 0), ("a", "y", "answer", 100), ("b", "x", "offer", 0), ("b", "y", "answer", 999)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda action: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).where(F.col("action") == action)
    q = control.matched_offers(read("offer"), read("answer"), "5 minutes", "10 minutes").writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.key for r in spark.table("met").collect()] == ["a"]


# ---- identity


def test_large_catalogs_match_as_small_ones_do(spark):
    texts = ["other words", "a Robe Robin lamp", "made by \u5149\u5cf0 and \u0421\u0432\u0435\u0442", "xMartin-y", "nothing", None, "a Robe Robin lamp"]
    docs = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "doc_id int, text string")
    catalog = spark.createDataFrame([("the", [], False), ("Robe", ["obe rob", "ROBIN"], False), ("\u5149\u5cf0", [], False), ("Свет", None, False), ("Martin-Y", ["artin"], False), ("absent", [], False)], "canonical string, aliases array<string>, requires_strong_signal boolean")
    small = sorted(map(tuple, identity.brand_candidates(docs, catalog).collect()))
    spelt = [(r.canonical, [r.canonical, *(r.aliases or [])]) for r in catalog.collect()]
    assert small == sorted((i % 6, c) for i, t in enumerate(texts) for c, words in spelt if any(w.lower() in (t or "").lower() for w in words))
    for limit in (1, 3):
        assert sorted(map(tuple, identity.brand_candidates(docs, catalog, limit=limit).collect())) == small


def test_identity_takes_the_model_from_any_source(spark):
    rows = [
        (1, "Cover words\nProduct line: Aura XB\nRobe lamps. The Robe is bright", "a.pdf", ("line", "Aura XB"), ("Robe", "Aura XB", True, "robe-aura-xb")),
        (2, "cover\nModel: MHX-250\nnothing else", "b.pdf", ("number", "MHX-250"), ("Unknown maker", "MHX-250", True, "unknown-maker-mhx-250")),
        (3, "=== PAGE 1 ===\nLumabeam\nUser Manual Rev. 2\n=== PAGE 2 ===\nThe Lumabeam is bright", "c.pdf", ("two_line", "Lumabeam"), ("Unknown maker", "Lumabeam", True, "unknown-maker-lumabeam")),
        (4, "W A S H E R\nbody", "d.pdf", ("spaced", "WASHER"), ("Unknown maker", "WASHER", True, "unknown-maker-washer")),
        (5, "Robe Spikie Wash\nbody", "e.pdf", ("title", "Robe Spikie Wash"), ("Unknown maker", "Robe Spikie Wash", True, "unknown-maker-robe-spikie-wash")),
        (6, "Robe Spikie Wash\nthank you for choosing Robe lamps", "f.pdf", ("title", "Robe Spikie Wash"), ("Robe", "Spikie Wash", True, "robe-spikie-wash")),
        (7, "text. Then nothing", "Spot 300X manual.pdf", None, ("Unknown maker", "300X", False, "unknown-maker-300x")),
        (8, "please read this user manual and the SPIKIE-7 owner's manual", "g.pdf", ("cover", "SPIKIE-7"), ("Unknown maker", "SPIKIE-7", True, "unknown-maker-spikie-7")),
    ]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id int, text string, source_name string")
    catalog = spark.createDataFrame([("Robe", [], False)], "canonical string, aliases array<string>, requires_strong_signal boolean")
    priority = spark.createDataFrame([], "rank int, canonical string, pattern string, min_hits int")
    assert {r.doc_id: (r.source, r.model) for r in identity.model_candidates(docs).collect()} == {r[0]: r[3] for r in rows if r[3]}
    got = identity.resolve_identity(docs, catalog, priority).collect()
    assert {r.doc_id: (r.manufacturer, r.model, r.from_manual, r.fixture_id) for r in got} == {r[0]: r[4] for r in rows} and len(got) == len(rows)
    assert {r.doc_id: r.filename_echo for r in got} == {r[0]: r[0] == 7 for r in rows}


def test_spellings_are_found_in_one_pass():
    find = identity.spelling_finder([("Robe", "robe", False), ("Robe", "robe lighting", False), ("That", "that", True), ("Probe", "probe", False)])
    got = {x["canonical"]: x for x in find("thatthat ®robe lighting, probe; robe's buying this robe product and this robe product.")}
    assert got["That"]["at"] == [] and got["Probe"]["at"] == [25] and got["Robe"]["at"] == [9, 32, 51, 73] and got["Robe"]["itself"]
    assert not {x["canonical"]: x for x in find("this robe products, xthis robe product")}["Robe"]["itself"]
    assert identity.spelling_finder([])("text") == []


def test_finding_time_does_not_follow_the_spellings():
    text = "some words of a manual about lamps and their makers " * 200
    took = {}
    for n in (2_000, 200_000):
        find = identity.spelling_finder([(f"maker {i}", f"maker{i} lamps", False) for i in range(n)])
        took[n] = min(timed(lambda: find(text)) for _ in range(5))
    assert took[200_000] < 5 * took[2_000] + 0.01


def timed(f):
    began = time.time()
    f()
    return time.time() - began


def test_long_sections_take_linear_time(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("section"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") % 3 > 0, (F.col("id") * 2 / 3).cast("int")).alias("channel"), (F.col("id") % 200).cast("int").alias("range_start"), (F.col("id") % 200 + 9).cast("int").alias("range_end"), F.lit("x").alias("label"), F.lit("full_row").alias("kind"))
    ranges = lines.select("doc_id", F.lit("c").alias("channel_id"), F.col("line_no").alias("range_idx"), (F.col("line_no") * 3 % 100_003).cast("int").alias("range_start"), (F.col("line_no") * 3 % 100_003 + 1).cast("int").alias("range_end"))
    rows.accept_in_sequence(lines.limit(10).where("channel is not null"), ["doc_id", "section"]).count()  # starts the workers
    for f in (lambda: rows.accept_in_sequence(lines.where("channel is not null"), ["doc_id", "section"]), lambda: rows.assign_ranges(lines), lambda: rows.recover_ordered_rows(lines), lambda: rows.drop_overlapping_ranges(ranges)):
        assert timed(lambda f=f: f().count()) < 10


def test_chains_of_parents_to_any_depth(spark):
    m = spark.createDataFrame([(1, i, i - 1, 20 - i) for i in range(1, 13)] + [(1, 13, 14, 5), (1, 14, 13, 5)], "doc_id int, mode_idx int, parent_idx int, prefix int")
    r = spark.createDataFrame([(1, 0, p, f"a{p}") for p in range(1, 21)] + [(1, 6, 3, "own"), (1, 13, 1, "x"), (1, 14, 2, "y")], "doc_id int, mode_idx int, position int, channel_id string")
    got = {}
    for x in modes.inherit_modes(m, r).collect():
        got.setdefault(x.mode_idx, {})[x.position] = x.channel_id
    assert got[12] == {p: "own" if p == 3 else f"a{p}" for p in range(1, 9)}
    assert got[13] == {1: "x"} and got[14] == {1: "x", 2: "y"}  # a later mode is no parent


def test_columns_follow_the_names_in_the_header():
    order = modes.column_order
    assert order(["Basic16", "Extended"], ["   Extended     Basic", "                  16"]) == [1, 0]
    assert order(["Basic16", "Extended"], ["   Extended     Basic", "16"]) == [0, 1]  # its parts are too far apart
    assert order(["Alpha", "Beta"], ["Beta", "Alpha"]) == [0, 1]  # one above the other
    assert order(["Alpha", "Beta"], ["Beta   only"]) == [0, 1]


def test_rules_of_components_and_headers(spark):
    docs = spark.createDataFrame([(1, "pan and tilt, 16-bit scan, rgbw leds"), (2, "RGBW only"), (3, "rgb color wheel")], "doc_id int, text string")
    got = {}
    for x in rows.component_scan(docs).collect():
        got.setdefault(x.doc_id, []).append(x.component)
    assert got[1] == ["Pan", "Tilt", "Pan fine", "Tilt fine", "Red", "Green", "Blue", "White"] and 2 not in got and got[3] == ["Color wheel"]
    lines = spark.createDataFrame([(1, 1, 1, "7 :"), (1, 1, 2, "Wash"), (1, 1, 3, "x" * 489), (1, 1, 4, "3 12 Function"), (2, 1, 1, "7: Wash"), (2, 1, 2, "x" * 499), (2, 1, 3, "3 12 Function")], "doc_id int, page int, line_no int, text string")
    assert [x.doc_id for x in modes.header_sparse(lines).collect()] == [1]


def test_prompts_go_with_edits(spark):
    queue = spark.createDataFrame([(1, "channel.confidence", "12"), (1, "channel.confidence", "2"), (1, "identity.model", ""), (2, "identity.model", "")], "doc_id int, prompt string, subject string")
    fixtures = spark.createDataFrame([(1, "M", "Unknown model"), (2, "M", "Unknown model")], "doc_id int, manufacturer string, model string")
    edits = spark.createDataFrame([(2, " ", " Spot ", 1, 1), (2, "New", "", 2, 2)], "doc_id int, manufacturer string, model string, ts int, event_id int")
    after = validate.apply_name_edits(fixtures, edits)
    assert [(x.manufacturer, x.model) for x in after.orderBy("doc_id").collect()] == [("M", "Unknown model"), ("New", "Spot")]
    left = validate.open_prompts(queue, spark.createDataFrame([(1, 0)], "doc_id int, channel_idx int"), after)
    assert sorted((x.doc_id, x.prompt, x.subject) for x in left.collect()) == [(1, "channel.confidence", "2"), (1, "identity.model", "")]


def test_streams_give_the_same_rows_however_they_are_cut(spark, tmp_path):
    r = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    events = sorted((start + datetime.timedelta(minutes=r.randrange(3000)), i, r.randrange(4)) for i in range(120))
    log = spark.createDataFrame([(c, i, ts, r.choice(["set", "set", "unlock", "end", "heartbeat"]), r.randrange(1, 6), r.choice([0, 9, 300]), r.randrange(2), r.random() < 0.3) for ts, i, c in events], "controller bigint, event_id bigint, ts timestamp, action string, channel int, value int, universe int, risky boolean")
    cuts = [start, *(start + datetime.timedelta(minutes=m) for m in (700, 1500, 2600)), start + datetime.timedelta(days=9)]
    parts = lambda k: [log.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts[:-1:k], [*cuts[k:-1:k], cuts[-1]])]
    out = {}
    for k in (1, 4):
        assert len(parts(k)) == 4 // k
        got = live.run_in_parts(spark, parts(k), lambda s: live.live_leases(s, 3600), str(tmp_path / f"leases{k}"))
        out[k] = sorted(map(repr, got.collect()))
    assert out[1] == out[4] and any("expired" in x for x in out[1])
    sources = log.select(F.col("controller").alias("key"), F.when(F.col("action") == "set", "lease").otherwise("socket").alias("source"), "ts")
    cut = lambda k: [sources.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts[:-1:k], [*cuts[k:-1:k], cuts[-1]])]
    spans = [sorted(map(repr, live.run_in_parts(spark, cut(k), lambda s: live.idle_spans(s, {"lease": 600, "socket": 1800}, 900), str(tmp_path / f"idle{k}")).collect())) for k in (2, 4)]
    assert spans[0] == spans[1] and spans[0]


def test_words_end_at_letters_that_are_not_ascii(spark):
    assert tx.ascii_edges(r"(?i)\bpan\b|\bs?x{2}\b|\d\b") == r"(?i)(?<!\w)pan(?!\w)|" + (edge := r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))") + rf"s?x{{2}}{edge}|\d{edge}"
    docs = spark.createDataFrame([(1, "panß und Ätilt, strobe"), (2, "span panel tilt_"), (3, "ünprism 16-bit scan panö")], "doc_id int, text string")
    got = sorted((x.doc_id, x.component) for x in rows.component_scan(docs).collect())
    assert got == [(1, "Light switch / strobe"), (1, "Pan"), (1, "Tilt"), (3, "Pan"), (3, "Pan fine")]


def test_priority_patterns_end_at_letters_that_are_not_ascii(spark):
    docs = spark.createDataFrame([(1, "von vonüber"), (2, "von vonuber"), (3, "evon")], "doc_id int, text string")
    priority = spark.createDataFrame([(1, "Gamma", r"\bvon\b", 2)], "rank int, canonical string, pattern string, min_hits int")
    picked = spark.createDataFrame([(2, "and")], "doc_id int, canonical string")
    got = sorted(tuple(x) for x in identity.known_brand_override(docs, priority, picked).collect())
    assert got == [(1, "Gamma", True), (2, "and", False), (3, None, False)]


def test_corroboration_is_linear_in_a_cover_line(spark):
    cover = "".join(f"word{i} " for i in range(6_000)) + "Wash 300X end"
    docs = spark.createDataFrame([(1, f"{cover}\nbody"), (2, f"{cover}\nthe wash 3oox"), (3, "Wash 300X"), (4, "\nbody"), (5, None)], "doc_id int, text string")
    picks = docs.select("doc_id", F.lit("Wash 3OO").alias("model"))
    identity.corroborate_model(docs.limit(0), picks).count()
    got = {}
    assert timed(lambda: got.update({x.doc_id: (x.model, x.exact) for x in identity.corroborate_model(docs, picks).collect()})) < 10
    assert got == {1: ("Wash 300X", False), 2: ("Wash 3OO", True), 3: ("Wash 300X", None), 4: (None, False), 5: (None, None)}


def test_open_format_docs_meet_by_document_alone(spark):
    from specmine.plans.case import Tables
    from specmine.plans.record_cases import open_docs

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = open_docs(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    keys = re.findall(r"SortMergeJoin \[(.*?)\]", plan)
    assert keys and not [x for x in keys if "," in x]


def test_matches_of_one_model_by_many_makers_and_of_many_copies(spark):
    n = 20_000
    prints = F.array((F.col("id") % 3).cast("int"))
    maker = lambda salt: F.substring(F.md5(F.concat(F.lit(salt), F.col("id").cast("string"))), 1, 12)
    queries = spark.range(n).select(F.col("id").alias("query_id"), maker("q").alias("manufacturer"), F.lit("Aura Spot").alias("model"), prints.alias("footprints"))
    listing = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") == 7, maker("q")).otherwise(maker("r")).alias("manufacturer"), F.lit("Aura Spot").alias("fixture"), (F.col("id") % 7 / 2).alias("rating"), prints.alias("footprints"))
    lookup.match_listing(queries.limit(5), listing.limit(5)).count()
    got = []
    assert timed(lambda: got.extend(lookup.match_listing(queries, listing).collect())) < 25
    assert [(x.query_id, x.rid) for x in got] == [(7, 7)]
    copies = lambda df: df.withColumn("manufacturer", F.lit("Robe"))
    small = lambda df: copies(df).limit(60)
    want = sorted(map(tuple, lookup.top_matches(lookup.match_listing(small(queries), small(listing))).collect()))
    assert sorted(map(tuple, lookup.best_matches(small(queries), small(listing)).collect())) == want and len(want) == 300
    assert timed(lambda: got.append(lookup.best_matches(copies(queries), copies(listing)).count())) < 25 and got[-1] == 5 * n


def test_files_of_their_own_are_written_by_many_tasks(spark, tmp_path):
    from specmine.plans import manual_cases, record_cases
    from specmine.plans.case import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    t.folder = lambda name: f"{tmp_path}/{name}"
    manual_cases._every_file(t)
    record_cases.fixture_files(t)
    for name in ("manuals", "fixtures"):
        tasks = [f.name.split("-")[1] for f in (tmp_path / name).rglob("part-*.txt")]
        assert len(tasks) > 1000 and len(set(tasks)) > 32


def test_appendix_lines_are_read_once(spark):
    text = ["Shutter", "0-9   Strobe fast ...", "10-19   Strobe off", "20-29   Page 7", "300-9   Open", "Mode table 2"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text, 1)], "doc_id long, line_no int, text string")
    out = rows.appendix_sections(lines)
    assert {(r.key, r.line_no, r.range_start, r.range_end, r.name, r.safety) for r in out.collect()} == {("shutter", 2, 0, 9, "Strobe fast", "strobe"), ("shutter", 3, 10, 19, "Strobe off", "normal")}
    filters = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("regexp_replace" in x or "regexp_extract" in x for x in filters)


def test_pages_are_counted_once(spark):
    rows_in = [(1, 1, "DMX chart", False), (1, 2, "plain", False), (1, 4, "plain", False), (2, 1, "0-1 2-3 4-5 6-7 8-9", True), (2, 2, "plain", None), (None, 1, "DMX chart", True), (None, 2, "plain", True), (3, 1, "plain", True)]
    out = pages.pages_for_detailed_read(spark.createDataFrame(rows_in, "doc_id long, page int, text string, from_ocr boolean"))
    assert {tuple(r) for r in out.collect()} == {(1, 1), (1, 2), (2, 1)} | {(None, 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_derived_lines_are_made_once(spark):
    """F12 F13 F15 F17 F18 F22: the windows over lineitem run once a query, written ahead, and lines read often are written as well."""
    from specmine.plans.case import QUERIES, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines = t.kept("lines")
    assert t.kept("lines").count() == lines.count() == bound(spark, "/root/testdata/sf0.001", "lines").count()
    plan = lines.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "Exchange" not in plan
    for name in ("m15_personality_rows", "m14_named_modes", "m3_reconcile_counts", "m14_inherited_rows", "m17_channel_counts", "r5_rejoin_split_digits"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" not in plan, name


def test_named_mode_parents_are_the_latest_before(spark):
    """parents are found without a join; a name that recurs, one that is not there and one that comes later."""
    text = ["Red DMX Mode", "4 DMX channels", "Blue DMX Mode", "5 DMX channels", "Channels 1-2 as in Red Mode", "RED DMX Mode", "6 DMX channels", "Channels 1-3 as in Green Mode", "Tail DMX Mode", "7 DMX channels", "Channels 1-4 as in red Mode", "FX list", "Channels 1-2 as in Blue Mode"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)] + [(2, 0, "Solo DMX Mode"), (2, 1, "4 DMX channels")], "doc_id long, line_no int, text string")
    m, _ = modes.named_modes(lines)
    assert sorted((r.mode_idx, r.name, r.size, r.parent_idx, r.prefix) for r in m.collect()) == [(0, "Red", 4, None, None), (1, "Blue", 5, 0, 2), (2, "Red", 6, None, 3), (3, "Tail", 7, 2, 4)]
    assert "SortMergeJoin" not in m._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" not in m._jdf.queryExecution().executedPlan().toString()


def test_pairing_of_small_and_large_buckets(spark):
    """What windows settle (one mode on a side, two on both; ties) is what best_of gives; larger buckets go through it. The
    step is read twice and written once."""
    import random

    import numpy as np

    from specmine.operators import evaluate

    rng, rows, expected = random.Random(3), [], set()
    for doc, (n, m) in enumerate([(1, 1), (1, 3), (3, 1), (2, 2), (1, 8), (8, 1), (2, 3), (7, 7), (4, 1), (6, 6)] * 6):
        table = np.array([[rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(m)] for _ in range(n)])
        rows += [(doc, 5, 10 + i, 20 + j, float(table[i, j])) for i in range(n) for j in range(m)]
        expected |= {(doc, 10 + i, 20 + j) for i, j in evaluate.best_of(table)}
    calls = []

    def once(df):
        calls.append(1)
        return spark.createDataFrame(df.collect(), df.schema)

    got = evaluate.best_pairing(spark.createDataFrame(rows, "doc_id long, footprint long, truth_mode int, mode int, name_score double"), once)
    assert {(r.doc_id, r.truth_mode, r.mode) for r in got.collect()} == expected and calls == [1]


def test_slots_are_dealt_out_by_document_once(spark):
    """A later channel's coarse byte overwrites a fine one; all of it, and what follows by document, after one shuffle by document."""
    from specmine.operators import evaluate

    modes = spark.createDataFrame([(1, 7, 0)], "mode_id long, fixture_id long, idx int")
    channels = spark.createDataFrame([(1, 1, None, 1, 2, "Pan", "P"), (2, 1, 1, 2, 2, None, "T"), (3, 1, 1, None, 9, "Z", "z")], "channel_id long, mode_id long, dmx_break int, offset_coarse int, offset_fine int, pretty string, attribute string")
    functions = spark.createDataFrame([(1,), (1,), (2,)], "channel_id long")
    got = evaluate.truth_slots(modes, channels, functions)
    assert sorted((r.doc_id, r.slot, r.name, r.n_functions, r.fine) for r in got.collect()) == [(7, 1, "Pan", 2, 0), (7, 2, "T", 1, 0), (7, 9, "Z", 0, 1)]
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()


def test_headers_gather_a_row_once(spark):
    """Labels glued and apart, an unread one that voids its row, a size named twice; a row's words are gathered by one
    aggregate without a count of distinct sizes beside it."""
    words = {1: ["3Ch", "6", "ch", "12 channels"], 2: ["3Ch", "fewCh", "6Ch"], 3: ["3Ch", "3", "Ch"], 4: ["3Ch", "text"], 5: ["7", "Ch", "9", "Ch"]}
    rows = spark.createDataFrame([(1, 1, r, i, t, i * 50.0, 10.0, 10.0) for r, ts in words.items() for i, t in enumerate(ts)], "doc_id long, page int, row_id int, item_no int, text string, x double, width double, height double")
    got = layout.detect_count_headers(rows)
    assert {r.row_id: (list(r.counts), list(r.centres)) for r in got.collect()} == {1: ([3, 6, 12], [5.0, 80.0, 155.0]), 5: ([7, 9], [30.0, 130.0])}
    assert "count(distinct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_searched_once_for_a_model(spark):
    docs = spark.createDataFrame([(1, "Spot 300X\nModel: X-3", "a.pdf")], "doc_id long, text string, source_name string")
    catalog = spark.createDataFrame([("ACME", [], False)], "canonical string, aliases array<string>, requires_strong_signal boolean")
    priority = spark.createDataFrame([], "rank int, canonical string, pattern string, min_hits int")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    steps = []

    def keep(df):
        steps.append(plan(df))
        return spark.createDataFrame(df.collect(), df.schema)

    out = identity.resolve_identity(docs, catalog, priority, keep)
    assert steps[0].count("product(?: line)?") == 1 and "product(?: line)?" not in "".join(steps[1:]) + plan(out)
    assert out.select("model", "from_manual").first() == ("X-3", True)
