"""Repeated word passages, conversation repair and spelling variants against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from specmine.llm import debruijn, repair, variants, word_queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(word_queries.QUERIES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = word_queries.QUERIES[name](spark, SF)
    c.execute(word_queries.ORACLES[name])
    at = [d[0] for d in c.description]
    assert sorted(at) == sorted(got.columns)
    mine, theirs = sorted(repr(tuple(r[x] for x in at)) for r in got.collect()), sorted(map(repr, c.fetchall()))
    assert mine == theirs and mine


# ---- repeated passages


def brute_words(rows, length=50):
    """Per row: words, and which of them a window covers that a smaller id has."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [i if i is not None else 1 << 62 for i, _ in rows]
    least = {}
    for w, r in zip(split, rank):
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            least[k] = min(r, least.get(k, r))
    out = []
    for w, r in zip(split, rank):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if least[tuple(w[p : p + length])] < r:
                gone[p : p + length] = [True] * length
        out.append((w, gone))
    return out


def passages(seed):
    r = random.Random(seed)
    vocab = ["ab", "c", "dé", "The", "the", "x\u00a0y", "z", "q1"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [text(n) for n in (50, 51, 70, 200, 400)]
    rows = []
    for i in range(70):
        parts = [text(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared).split()
            a = r.choice([0, 0, r.randrange(len(p))])
            parts += [" ".join(p[a : a + r.choice([len(p), 60])]), text(r.choice([0, 3, 40]))]
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(70, None), (71, ""), (72, " \n"), (73, "a " * 300), (74, "a " * 180), (75, "ab c " * 120), (3, shared[3]), (3, shared[3] + " own"), (None, shared[4]), rows[5], rows[5], (76, text(20_000) + " " + shared[2])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words_are_removed_exactly(spark, seed):
    rows = passages(seed)
    docs = spark.createDataFrame([(i, t, "k", "pos", 1) for i, t in rows], "doc_id bigint, text string, k string, pos string, rank int").repartition(3)
    got = Counter((x.doc_id, x.n_words, bytes(x.kept), tuple((s.start, s.end) for s in x.spans)) for x in debruijn.remove_repeats(docs).collect())
    want = Counter()
    for (i, _), (w, gone) in zip(rows, brute_words(rows)):
        edges = [p for p in range(len(w) + 1) if (p < len(w) and gone[p]) != (p > 0 and gone[p - 1])]
        want[i, len(w), " ".join(x for x, g in zip(w, gone) if not g).encode(), tuple(zip(edges[::2], edges[1::2]))] += 1
    assert got == want


def test_spans_name_the_place_in_their_source(spark):
    rows = [(i, t) for i, t in passages(3) if i is not None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    keys = {(r.k, r.doc_id): re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text").collect()}
    spans = debruijn.repeated_spans(docs).where("src_k is not null").collect()
    assert any(s.n > 60 for s in spans)  # whole paths, not single stretches
    for s in spans:
        assert s.src_rank < s["rank"]
        assert keys[s.k, s["rank"]][s.pos : s.pos + s.n + 49] == keys[s.src_k, s.src_rank][s.src_pos : s.src_pos + s.n + 49]


def test_no_documents(spark):
    assert debruijn.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


# ---- conversations


def cheapest(rows):
    """Cost and audit by trying every edit, with up to two insertions at a place. rows: (initial, must go, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for c in "ua":
                if (state, c) in step:
                    cost, audit = best(i, step[state, c], inserted + 1)
                    out.append((cost + 3, "I" + audit))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            cost, audit = best(i + 1, state, 0)
            out.append((cost + 4, "D" + audit))
            if not must_go:
                for edit, price, c in [("K", 0, initial), ("R", 3, "u"), ("R", 3, "a")]:
                    if (state, c) in step:
                        cost, audit = best(i + 1, step[state, c], 0)
                        out.append((cost + price + 3 * truncated, edit + audit))
        return min(out, default=(10**9, ""))

    return best(0, "", 0)


def test_repairs_are_the_cheapest_and_least():
    r = random.Random(7)
    for _ in range(1500):
        rows = [(r.choice("suuaaax"), r.random() < 0.15, r.random() < 0.2) for _ in range(r.randint(0, 9))]
        parse = repair.Parse()
        for i, (initial, must_go, truncated) in enumerate(rows):
            parse.row(initial, must_go, truncated, initial.encode(), str(i).encode())
        assert parse.end()[:2] == cheapest(tuple(rows)), rows


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, cost int, audit string")


def test_repaired_messages_have_the_digest(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "user"]), r.choice(["Fine.", "cut of", " ", "", f"Text {t}!", "line\nbreak?  "]), 1, "x") for c in range(60) for t in range(r.randint(0, 9))]
    rows += [(None, None, None, None, 1, "x"), (None, 2, "user", "Hello.", 1, "x"), (99, None, "user", "A.", 1, "x"), (99, None, "assistant", "B.", 1, "x"), (98, 3, "", "Empty role.", 1, "x"), (97, 1, "user", "Same.", 1, "x"), (97, 1, "user", "Same.", 1, "x")]
    rows += [(96, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", 1, "x") for t in range(5000)]
    done = repair.repair(talk(spark, rows))
    messages = {}
    for m in repair.repaired_messages(talk(spark, rows), done).collect():
        messages.setdefault(m.conv_id, []).append((m.place, f"{m.role}:{m.text}"))
    found = {x.conv_id: x for x in done.collect()}
    assert set(found) == {x[0] for x in rows}
    for c, x in found.items():
        lines = [m for _, m in sorted(messages.get(c, []))]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[:1] for m in lines)), (c, x.audit)
        assert x.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert (found[99].gaps, found[97].duplicate, found[98].illegal, found[96].audit) == (0, 1, 0, "K" * 5000)
    assert repair.repair(talk(spark, [])).collect() == []


def test_damage_and_dropped_conversations(spark):
    rows = talk(spark, [(c, 0, "user", "One. Two!", 1, "x") for c in range(400)])
    kinds = Counter((x.there, x.role, x.text, x.copy) for x in word_queries.damaged(rows).collect())
    assert {k[1:3] for k in kinds if k[0]} == {("user", "One. Two!"), ("user", ""), ("user", "One Two")} and any(not k[0] for k in kinds) and any(k[3] for k in kinds)
    done = repair.repair(word_queries.damaged(rows), there=F.col("there"), copy=F.col("copy")).collect()
    assert len(done) == 400
    empty = [x for x in done if not x.audit]
    assert empty and all(x.repaired_sha256 == hashlib.sha256(b"").hexdigest() and x.cost == 0 for x in empty)


# ---- spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_by_brute_force(spark, seed):
    r = random.Random(seed)
    words = set()
    for _ in range(120):
        w = "".join(r.choice("abé" if seed < 3 else "abcdefghijklmnß") for _ in range(r.randint(7, 12)))
        words.add(w)
        for _ in range(3):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abéz") + w[i:], w[:i] + r.choice("abéz") + w[i + 1 :]])
            if len(w) >= 4:
                words.add(w)
    counts = {w: r.choice([2, 3, 20, 30, 250, 3000]) for w in words}
    table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 5, "x")], "word string, n bigint, form string").repartition(5)
    form, want = {}, {}
    for w in words:
        close = sorted((v for v in words if near(v, w)), key=lambda v: (-counts[v], v))
        form[w] = close[0] if close and counts[close[0]] >= 10 * counts[w] else None
        want[w] = len(close)
    got = variants.group_variants(table).collect()
    assert len(got) == len(words)
    for x in got:
        root = x.word
        while form[root]:
            root = form[root]
        assert (x.form, x.root, x.n, x.n_near, x.form_n) == (form[x.word], root, counts[x.word], want[x.word], counts.get(form[x.word])), x.word
    assert max(want.values()) > 2


def test_words_of_documents(spark):
    rows = [(1, "Straßenbahn straßenbahn STRASSENBAHN kürzer Kürzeste kürzeste", "en", "s", 1), (None, "kürzeste x", "en", "s", 1), (2, None, "en", "s", 1), (3, "a" * 50_000 + " " + "a" * 50_000, "en", "s", 1)]
    got = {x.word: x.n for x in word_queries.misspelt_words(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(len(w) >= 7 and n >= 2 for w, n in got.items()) and sum(got.values()) >= 5
    assert word_queries.misspelt_words(spark.createDataFrame([], DOCS)).collect() == []
    assert variants.group_variants(spark.createDataFrame([], "word string, n bigint")).collect() == []
