"""The pipeline's stages on a small table, each against its rule."""

import random
import re

import corpus_pipeline
from specmine.llm.common import materialize


def test_stages(spark, tmp_path):
    r = random.Random(3)
    vocab = {"en": "the and of thing ever there with shall then other".split(), "de": "der und die nicht schein über keit ung gegen würde".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(r.choice(vocab[lang]) + r.choice(["", "er", "en"]) + str(r.randrange(9)) * r.randrange(2) for _ in range(60)), lang, "s", 0))
    passage = "é".join(f"passage{i}" for i in range(12))
    item = " ".join(f"bench{i}" for i in range(15))
    rows += [(100, rows[3][1], "en", "s", 0), (101, "12 34 !!", "en", "s", 0), (102, None, "en", "s", 0), (103, " ".join(reversed(rows[4][1].split())) + " " + passage, "de", "s", 0), (104, rows[5][1][:200] + passage + " tail", "en", "s", 0), (105, "own words first " + item, "en", "s", 0)]
    rows = [(i, t, g, s, len(t or "")) for i, t, g, s, _ in rows]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        seen[name] = {x.doc_id: x for x in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(seen["language_id"]) == {i for i, *_ in rows} - {101, 102}
    assert set(seen["language_id"]) - set(seen["near_dedup"]) == {100}
    cut = seen["repeat_removal"]
    assert passage in cut[103].text and passage[1:-1] not in cut[104].text and cut[104].text.endswith("tail")
    assert "�" not in cut[104].text and cut[104].n_chars == len(cut[104].text)
    assert all(cut[i].text == rows[i][1] for i in range(60))
    assert set(cut) - set(seen["decontamination"]) == {105}
    got = spark.read.parquet(f"{sf}/documents.parquet").sparkSession
    packed = corpus_pipeline.run(got, sf)
    assert {x.doc_id for x in packed.collect()} == set(seen["decontamination"])
    assert re.match("doc_id", packed.columns[0])


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, a genuine replacement character, another column, no rows at all."""
    sf, schema = str(tmp_path / "sf"), "doc_id bigint, text string, lang string, source string, n_chars bigint, _hits string"
    passage = " ".join(f"ü{i}ß" for i in range(20))
    words = lambda w, n: " ".join(f"{w}{i % 7}{w}" for i in range(n))
    rows = [(1, "start \ufffd " + passage, "de", "s", 9, "x"), (2, "the end \ufffd" + passage[1:] + " \ufffd of it", "en", "s", 9, None), (None, words("lorem", 30), "en", None, None, "y"), (None, words("lorem", 30), "en", None, None, "y"), (5, None, None, None, None, None), (5, "", "en", "s", 0, None), (7, words("ipsum", 9), None, "s", 9, "z")]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "no such words here")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(x.doc_id or 0 for x in stages["language_id"](spark, docs, sf).collect()) == [0, 0, 1, 2, 7]
    assert sorted(x.doc_id or 0 for x in stages["near_dedup"](spark, docs, sf).collect()) == [0, 1, 2, 5, 5, 7]
    cut = {x.doc_id: x.text for x in stages["repeat_removal"](spark, docs.where("doc_id < 5"), sf).collect()}
    assert cut == {1: rows[0][1], 2: "the end \ufffd \ufffd of it"} or cut[2].count("\ufffd") == 2 and passage[3:-3] not in cut[2]
    assert stages["decontamination"](spark, docs, sf).count() == len(rows)
    packed = stages["best_fit_packing"](spark, docs, sf).collect()
    assert len(packed) == len(rows) and sum(x.doc_id is None for x in packed) == 2
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS)
