"""The language model, WARC source, HTML extraction and licence scan, against definitions."""

import gzip
import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specmine.llm import html_density, licenses, ngram_lm, queries, warc

# ---- language model


def test_elias_fano_finds_what_it_holds():
    r = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 5), (1000, 5000), (3000, 1 << 50), (70, 71)):
        values = np.sort(r.choice(min(universe, 1 << 40), n, replace=False).astype(np.uint64) * np.uint64(max(1, universe >> 40)))
        ef = ngram_lm.ef_encode(values, universe)
        keys = np.unique(np.concatenate((values, r.integers(0, universe, 200, dtype=np.uint64))))
        where = {int(v): i for i, v in enumerate(values)}
        assert ngram_lm.ef_find(ef, keys).tolist() == [where.get(int(k), -1) for k in keys]


def test_elias_fano_ranges_are_read_in_one_pass():
    """op7: where the values of a high part begin is read off the same word as where they end, over words' edges too."""
    rng = np.random.default_rng(3)
    for n, universe in ((1, 1), (700, 900), (900, 40_000), (5_000, 10**11)):
        values = np.unique(np.concatenate([rng.integers(0, universe, n), np.arange(min(universe, 300))]).astype(np.uint64))
        ef = ngram_lm.ef_encode(values, universe)
        high = (values >> np.uint64(int(ef["low"][0]))).astype(np.int64)
        asked = np.arange(int(high[-1]) + 1) if high[-1] < 10_000 else np.unique(high)
        begin, end = ngram_lm._ranges(ef, asked)
        assert begin.tolist() == np.searchsorted(high, asked, "left").tolist()
        assert end.tolist() == np.searchsorted(high, asked, "right").tolist()


def reference_scores(train, texts, least=1, less=0.75):
    """The same model by dictionaries, without quantisation."""
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["</s>"]
    uni, two, three = Counter(), Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        two.update(zip(["</s>", *w], w))
        three.update(zip(["</s>", *w], w, w[1:]))
    n, types = sum(uni.values()), len(uni)
    ones, twos = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = ones / (ones + 2 * twos) if ones else 0
    unknown = max(d * types / n, 1 / (n + 1)) if n else 1
    kept2 = {k: c for k, c in two.items() if c >= least}
    kept3 = {k: c for k, c in three.items() if c >= least and k[:2] in kept2 and k[1:] in kept2}
    total2, given2, given3 = Counter(), Counter(), Counter()
    for k, c in two.items():
        total2[k[0]] += c
    for k, c in kept2.items():
        given2[k[0]] += (c - less) / total2[k[0]]
    for k, c in kept3.items():
        given3[k[:2]] += (c - less) / two[k[:2]]

    def p(a, b, w):
        one = (uni[w] - d) / n if uni[w] else unknown
        second = (kept2[b, w] - less) / total2[b] if (b, w) in kept2 else 0
        q = second + max(1 - given2[b], 1e-9) * one if uni[b] else one
        if a is not None and (a, b) in kept2:
            q = ((kept3[a, b, w] - less) / two[a, b] if (a, b, w) in kept3 else 0) + max(1 - given3[a, b], 1e-9) * q
        return q

    out = []
    for t in texts:
        w = words(t)
        before = ["</s>", *w]
        score = sum(math.log10(p(before[i - 1] if i else None, before[i], x)) for i, x in enumerate(w)) if n else 0
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (types + 1))) for x in w)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def test_scores_by_definition(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 100)
    r = random.Random(2)
    texts = [" ".join(r.choice("Ab c\td e f g h ih iij".split(" ")) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "zz top", "a b\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for least in (1, 2):
        model = ngram_lm.train(docs.where("doc_id < 50"), min_count=least)
        assert model.bigram_shards > 2 and model.trigram_shards > 1
        # frequent contexts lie in several shards of 100 tokens
        assert len(model.cut_words.ids) > 2 and (least > 1 or len(model.cut_bigrams.ids) > 2)
        rows = {x.doc_id: x for x in ngram_lm.score(docs, model).collect()}
        for i, (tokens, known, n, base, score) in enumerate(reference_scores(texts[:50], texts, least)):
            x = rows[i]
            assert (x.n_tokens, x.n_known, x.train_tokens) == (tokens, known, n)
            # three rounded values a token at most, each by half a step
            assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score, abs=2 / ngram_lm.STEP * tokens)
    empty = ngram_lm.score(docs, ngram_lm.train(docs.where("false"))).collect()
    assert {x.score for x in empty} == {0.0}


def test_held_out_documents_are_likelier_than_by_word_counts(spark):
    rows = queries.op7_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert rows[2] > 50 and rows[0] > rows[1]


# ---- WARC


def test_archives_round_trip(spark, tmp_path):
    warc.register(spark)
    rows = [(f"<urn:page:{i}>", "response" if i % 3 else "revisit", f"http://x/{i}", f"2020-01-0{i % 9 + 1}T00:00:00Z", None if i % 3 else "<urn:page:1>", (b"p%d \r\n\r\n\xff" % i) * (i * 50) if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, warc.WRITES)
    top = str(tmp_path / "w")
    df.repartition(3).write.format("warc").mode("append").option("path", top).save()
    got = {r.record_id: r for r in spark.read.format("warc").load(top).collect()}
    assert len(got) == 40
    for ident, kind, uri, date, refers, payload in rows:
        r, payload = got[ident], payload or b""
        assert (r.type, r.target_uri, r.date, r.refers_to, r.payload_bytes, r.payload_digest) == (kind, uri, date, refers, len(payload), warc.digest_of(payload))
        assert bytes(r.payload) == (payload if kind == "response" else b"")
    some = spark.read.format("warc").option("payloads", "").load(top).where("type = 'response' and target_uri in ('http://x/4', 'http://x/5', 'http://x/6')")
    assert sorted((r.target_uri, r.payload) for r in some.collect()) == [("http://x/4", None), ("http://x/5", None)]
    # what other tools write: no sizes in the gzip header, or no compression at all
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(plain)
    members = [warc.record_bytes(dict(zip(("record_id", "type", "target_uri", "date", "refers_to", "payload"), r))) for r in rows]
    (other / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    assert spark.read.format("warc").load(str(other)).groupBy("record_id").count().where("count = 2").count() == 40
    skipped = lambda: spark.read.format("warc").option("payloads", "revisit").load(str(other))
    assert skipped().where("type = 'response' and payload is not null").count() == 0 and skipped().count() == 80
    # one frame in many scans, and predicates bound to a frame
    f = spark.read.format("warc").load(top)
    one, two = f.where("type = 'response'"), f.where("type = 'revisit'")
    assert (one.count(), two.count(), f.count(), f.union(one).count()) == (26, 14, 40, 66)
    assert one.alias("x").join(two.alias("y"), F.col("x.record_id") != F.col("y.record_id")).count() == 26 * 14
    bound = warc.read_archive(spark, top, where={"type": ["response"], "target_uri": ["http://x/4", "http://x/6"]}, payloads=[])
    assert [(r.target_uri, r.payload) for r in bound.collect()] == [("http://x/4", None)]
    assert bound.where("type = 'revisit'").count() == 0 and bound.count() == 1
    once = spark.read.format("warc").option("pushdown", "true").load(top).where("type = 'response'")
    assert once.count() == 26
    # an archive that ends within a record is an error, wherever it was cut
    for data in (plain, b"".join(map(gzip.compress, members)), b"".join(map(warc.member, members))):
        whole = list(warc.records(warc.Bytes(io.BytesIO(data), 0, len(data)), lambda h: True))
        assert len(whole) == 40
        for cut in (len(data) - 5, len(data) // 2, len(data) // 3, 7):
            for keep in (True, False):
                with pytest.raises((warc.Truncated, zlib.error)):
                    if len(list(warc.records(warc.Bytes(io.BytesIO(data[:cut]), 0, cut), lambda h: keep))) < 40:
                        raise AssertionError(f"lost records without an error, cut at {cut}")
                    raise warc.Truncated
    assert warc.headers_of(warc.record_bytes({"type": "response", "target_uri": "http://x/a  b\r\n c", "payload": None}).partition(b"\r\n\r\n")[0])["warc-target-uri"] == "http://x/a  b  c"
    (tmp_path / "none").mkdir()
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0


def test_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", None), (4, "u", ""), (5, "u", "y"), (None, "u", "x"), (2, "u", "x")], "page_id bigint, url string, html string")
    got = sorted((r.page_id or -1, r._original) for r in warc.mark_revisits(pages, id_col="page_id", payload_col="html").collect())
    assert got == [(-1, 2), (1, 2), (2, None), (2, None), (3, 4), (4, None), (5, None)]
    assert warc.mark_revisits(pages, id_col="page_id", payload_col="html", min_bytes=1).where("page_id = 3 and _original is null").count() == 1


def test_revisits_with_clashing_columns_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "x", "a", "b"), (2, "x", None, "c")], "page_id bigint, html string, _payload_digest string, _original string")
    got = warc.mark_revisits(pages, id_col="page_id", payload_col="html", out_col="first")
    assert sorted((r.page_id, r._payload_digest, r._original, r["first"]) for r in got.collect()) == [(1, "a", "b", 2), (2, None, "c", None)]
    assert warc.mark_revisits(pages.where("false"), id_col="page_id", payload_col="html").count() == 0


def test_archived_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    largest = {}
    for i, b in pages.items():
        largest[b] = max(i, largest.get(b, i))
    rows = queries.op6_warc(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        b = pages[r.page_id]
        first = largest[b] == r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), warc.digest_of(b), "response" if first else "revisit", None if first else largest[b])


# ---- HTML


def truth(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", inner)).split())


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in queries.op8_html_extraction(spark, "/root/testdata/sf0.01").collect():
        assert r.text == truth(pages[r.page_id]) and r.n_chars == len(r.text)


def test_pages_without_article_element():
    p = "<p>" + "Some longer sentence of the text, with words. " * 6 + "</p>"
    page = f"<html><head><title>t</title><body><header><h1>Site</h1></header><div class='top menu'><a href=/a>A</a><a href=/b>B</a></div><div id=content><h2>Title &amp; more</h2>{p}{p}<ul><li>one<li>two</ul>{p}</div><div class='sidebar'><p>Other things to read here</p></div><div id='comments'><p>{'I think so too. ' * 40}</p></div><form><p>Mail</p></form><footer>foot</footer>"
    text = html_density.main_text(page)
    assert text.startswith("Title & more Some longer") and "one two" in text and text.endswith("words.")
    assert not any(x in text for x in ("Site", "Other things", "I think", "Mail", "foot"))
    parts = "".join(f"<section><h3>Part {i}</h3>{p}{p}</section>" for i in range(3))
    assert html_density.main_text(f"<body><nav><a>x</a></nav><div>{parts}</div></body>").count("Part") == 3
    assert [html_density.main_text(x) for x in (None, "", "<p></p>", "<script>x</script>", "<nav>x</nav>", "<")] == ["", "", "", "", "", "<"]
    assert html_density.main_text("plain &lt;text&gt;\n here") == "plain <text> here"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert html_density.main_text(deep) == "deep text"


def brute_choice(tree):
    """Densities by their definition over a tree of (tag, text, children, is_link): the path to the
    node with the largest sum over its children, of equals the innermost."""

    def measure(node):
        tag, text, children = node
        chars, tags, lc, lt = len(text), 0, 0, 0
        for child in children:
            if child[0] == "a":
                chars, tags, lc, lt = chars + len(child[1]), tags + 1, lc + len(child[1]), lt + 1
            else:
                c, t, x, y = measure(child)
                chars, tags, lc, lt = chars + c, tags + t + 1, lc + x, lt + y
        return chars, tags, lc, lt

    c, _, lc, _ = measure(tree)
    share = lc / c

    def density(node):
        c, t, lc, lt = measure(node)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / max(0.1, math.log(base))

    sums = {}

    def walk(node, path):
        inner = [x for x in node[2] if x[0] != "a"]
        sums[path] = sum(density(x) for x in inner)
        for i, x in enumerate(inner):
            walk(x, (*path, i))

    walk(tree, ())
    top = max(sums.values())
    return {p for p, v in sums.items() if math.isclose(v, top)}


def test_densest_subtree_by_brute_force():
    r = random.Random(12)

    def grow(depth):
        children = [grow(depth + 1) for _ in range(r.randint(0, 4))] if depth < 4 else []
        children += [("a", "x" * r.randint(1, 9), [])] * (r.random() < 0.3)
        return ("div", "w" * r.choice((0, 0, 3, 40, 200)), children)

    def markup(node):
        return f"<{node[0]}>{node[1]}{''.join(map(markup, node[2]))}</{node[0]}>"

    for _ in range(60):
        tree = grow(0)
        page = markup(tree)
        if not re.sub("<[^>]*>", "", page):
            continue
        nodes = html_density.parse(f"<body>{tree[1]}{''.join(map(markup, tree[2]))}</body>")
        html_density.densities(nodes)
        paths, best = {id(nodes[0]): ()}, nodes[0]
        for n in nodes:
            for i, x in enumerate(n.children):
                paths[id(x)] = (*paths[id(n)], i)
            if n.total > best.total:
                best = n
        assert paths[id(best)] in brute_choice(tree)


def test_sections_of_an_article_stay():
    p = "<p>" + "Some longer sentence of the text, with words. " * 6 + "</p>"
    for name in ("class=notice", "class=banner-story", "class=comment-on-law", "class=share-prices", "class=login-security", "class=widget-design", "class=alert", "class=search-theory", "id=related-work"):
        text = html_density.main_text(f"<body><nav><a href=/>x</a></nav><article><h1>T</h1>{p}<section {name}><p>Kept here.</p></section>{p}<p>A <span class=advert>buy <span>it</span> now</span><b hidden>not</b> end.</p></article></body>")
        assert text.startswith("T Some") and "Kept here." in text and text.endswith("A end."), (name, text)
    linked = "<div class=related><a href=/1>One more</a> <a href=/2>and two</a></div>"
    assert "One more" not in html_density.main_text(f"<body><article><h1>T</h1>{p}{linked}{p}</article></body>")
    ad = "<div class=ad>" + "Buy this thing. " * 50 + "</div>"
    assert html_density.main_text(f"<body>{ad}<article><p>Short text.</p></article></body>") == "Short text."
    assert html_density.main_text(f"<body><article>{p}{p}</article><div class=comments><p>{'So true. ' * 400}</p></div></body>").count("So true") == 0
    # the density decides, not the element's name: a short article element beside the text
    assert html_density.main_text(f"<body><article><p>Teaser</p></article><div>{p}{p}{p}</div></body>").startswith("Some longer")
    assert html_density.main_text(f"<body><div><h1>Headline</h1><div>{p}{p}</div></div><div class=x><a href=/>y</a></div></body>").startswith("Headline Some")


def test_time_is_linear_in_depth():
    n = 60_000
    for page in ("<div>" * n + "deep text" + "</div>" * n, "<div>" * n + "<p>a</x></li>" * n, "<p><span>" * n + "deep"):
        began = time.time()
        assert html_density.main_text(page)
        assert time.time() - began < 20
    assert html_density.extract


def test_pages_table_edge_cases(spark):
    pages = spark.createDataFrame([(1, "u", None, "a"), (1, "u", "", None), (None, None, "<p>x</p>", "b"), (2, "u", "<p>x</p>", "b")], "page_id bigint, url string, html string, text string")
    got = html_density.extract(pages)
    assert got.columns == ["page_id", "url", "text"] and sorted(r.text for r in got.collect()) == ["", "", "x", "x"]
    assert html_density.extract(pages.where("false")).count() == 0


def test_wrapper_classes_keep_the_article():
    p = "<p>" + "Some longer sentence of the text, with words. " * 6 + "</p>"
    side = "<div class='sidebar'><p>Other things to read here</p></div>"
    for wrapper in ("id=page class='has-sidebar'", "class='content-with-sidebar'", "class='no-comments'", "class='related-view'", "class='search-result'", "id=search", "class='wide sidebar'"):
        for inner in (f"<article><h2>Title</h2>{p}</article>", f"<h2>Title</h2>{p}{p}{p}"):
            text = html_density.main_text(f"<body><nav><a href=/>x</a></nav><div {wrapper}>{inner}{side}</div><footer>foot</footer></body>")
            assert text.startswith("Title Some longer") and text.endswith("words."), (wrapper, text)
            assert "Other things" not in text and "foot" not in text
    page = f"<body><article>{p}<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p></article><div class='comments'><article class=comment><p>Well said</p></article></div></body>"
    assert "So E=m holds." in html_density.main_text(page) and "Well said" not in html_density.main_text(page)


def test_extract_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "<p>a<p>b", "old")], "page_id bigint, html string, text string")
    assert [(r.page_id, r.text) for r in html_density.extract(df).orderBy("page_id").collect()] == [(1, ""), (2, "a b")]


# ---- licences


def test_licences(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
    texts = [mit, "Title\nReleased under the MIT License.\nMore", "x. Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", None, "", mit[400:], "This work is licensed under the GNU General Public License, version 3.", "license", "Licensed under CC BY-NC-SA 4.0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["MIT"], ["Apache", "CC-BY-NC"], [], [], [], ["GPL"], [], ["CC-BY-NC-SA"]]
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert hashlib and licenses.scan(df.where("false")).count() == 0


def test_licences_of_real_notices(spark):
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
    fsf = "This {0} is free software{1} you can redistribute it and/or\nmodify it under the terms of the GNU {2}\nas published by the Free Software Foundation{3} either version {4} of\nthe License, or (at your option) any later version.\n"
    isc = "Copyright (c) 2020 Someone\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    zlib = "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"
    notices = [
        (apache, "Apache"),
        (fsf.format("program", ";", "General Public License", ";", 2), "GPL"),
        (fsf.format("program", ":", "General Public License", ",", 3), "GPL"),
        (fsf.format("library", ";", "Lesser General Public License", ";", 2.1), "LGPL"),
        (fsf.format("program", ":", "Affero General Public License", ",", 3), "AGPL"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy\n", "MPL"),
        ("This is free and unencumbered software released into the public domain.\n", "Unlicense"),
        (isc, "ISC"),
        (zlib, "Zlib"),
        ("Distributed under the Boost Software License, Version 1.0.\n", "BSL"),
        ("This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html\n", "EPL"),
        ("Licensed under the Apache License, Version 2.0.\n", "Apache"),
    ]
    marks = ["", "# ", "// ", " * ", "-- ", ";; ", "## "]
    rows = [(i, "\n".join((m + line).rstrip() for line in text.split("\n")), name) for i, (text, name, m) in enumerate((t, n, m) for t, n in notices for m in marks)]
    df = spark.createDataFrame(rows, "doc_id int, text string, name string")
    assert [(r.text, r.licenses) for r in licenses.scan(df).collect()] == [(t, [n]) for _, t, n in rows]


def test_words_of_furniture_need_structure_or_place():
    body = "<p>" + "Long text of the article about many things. " * 6 + "</p>"
    page = lambda probe: f"<html><body><nav><a href=x>menu</a></nav><article><h1>T</h1>{body * 2}{probe}{body}</article></body></html>"
    for kept in ('<p class="comment">PROBE words</p>', '<div class="promo">PROBE words</div>', "<menu><li>PROBE one</li><li>two</li></menu>"):
        assert "PROBE" in html_density.main_text(page(kept)), kept
    many = '<div class="comment">PROBE fine</div>' * 2
    for gone in ('<div class="ad-box">PROBE</div>', '<div class="user-comments"><p>PROBE</p></div>', '<div class="newsletter-signup">PROBE</div>', '<section id="related-articles">PROBE</section>', many, '<menu><li><a href="x">PROBE</a></li></menu>'):
        assert "PROBE" not in html_density.main_text(page(gone)), gone


def test_time_is_linear_in_unclosed_declarations():
    began = time.time()
    assert html_density.main_text("<!" * 500_000) == ""
    assert time.time() - began < 2
