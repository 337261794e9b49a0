"""The text operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specmine.llm import decontam, fingerprints, langid, minhash, packing, queries, suffix_dedup
from specmine.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, start=0):
    return spark.createDataFrame([(None if t == "NULLID" else i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def corpus(seed, n, words=40, vocabulary=30):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, words))) for _ in range(n)]
    for _ in range(n):  # shared passages
        a, b = r.randrange(n), r.randrange(n)
        i = r.randrange(len(texts[a]) + 1)
        texts[b] = texts[b][: r.randrange(len(texts[b]) + 1)] + texts[a][i : i + r.randint(20, 90)] + texts[b][-5:]
    return [*texts, None, "", "a" * 400, "a" * 130, "xy" * 100, texts[0], texts[0], "a" * 49, "a" * 50]


# ---- suffix-array dedup


def brute_removed(texts, length=50):
    seen, out = {}, []
    data = [(t or "").encode() for t in texts]
    for d in data:
        out.append(np.zeros(len(d), bool))
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            w = d[p : p + length]
            if seen.setdefault(w, i) < i:
                out[i][p : p + length] = True
    return data, out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_removed_exactly(spark, seed, monkeypatch):
    texts = corpus(seed, 60)
    texts.append("".join(chr(97 + i % 26) for i in range(150_000)))  # longer than a segment, periodic
    texts.append("q" + texts[-1][70_000:70_300])
    data, gone = brute_removed(texts)
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, texts).repartition(3)).collect()}
    assert len(rows) == len(texts)
    for i, (d, g) in enumerate(zip(data, gone)):
        assert bytes(rows[i].kept) == bytes(b for b, x in zip(d, g) if not x), i
        edges = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(int), [0]))))
        assert [(s.start, s.end) for s in rows[i].spans] == list(zip(edges[::2], edges[1::2]))


@pytest.mark.parametrize("hot", [16, 3])
def test_repeats_at_hot_anchors(spark, hot, monkeypatch):
    """A passage that most documents share, each with its own words around it: hot in some chunks only."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = letters(180)
    texts = [letters(r.randint(0, 90)) + passage[r.choice((0, 0, 3)) :] + letters(r.randint(0, 90)) for _ in range(90)]
    texts += [letters(5) + "cdabc" + passage[:60], letters(9) + "cdabc" + passage[:60] + "zz", passage, passage, None]
    data, gone = brute_removed(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    # one part with nearly all of them, and parts in which the anchors aren't hot
    docs = docs.where("doc_id % 9 > 1").coalesce(1).unionByName(docs.where("doc_id % 9 <= 1").repartition(5))
    rows = docs.unionByName(docs.where("doc_id % 7 = 0"))  # repeated rows
    for got in suffix_dedup.remove_repeats(rows, keep=["lang"]).collect():
        d, g = data[got.doc_id], gone[got.doc_id]
        assert bytes(got.kept) == bytes(b for b, x in zip(d, g) if not x), got.doc_id


def test_repeats_small_buckets(spark):
    texts = corpus(5, 40)
    found = suffix_dedup.repeated_spans(table(spark, texts), bucket_bytes=500)
    assert found.count() > 0
    assert suffix_dedup.remove_repeats(table(spark, []).where("false")).count() == 0


def test_longest_previous_factor_by_definition():
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(12)) for _ in range(60)]
    ids = np.array([r.randrange(20) for _ in words])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    order, lcp = suffix_dedup.suffix_order(data, np.arange(60) * 12, 12)
    got = np.zeros(60, int)
    got[order] = suffix_dedup.longest_previous_factors(ids[order], lcp)

    def common(a, b):
        return next((i for i in range(12) if a[i] != b[i]), 12)

    for i, w in enumerate(words):
        assert got[i] == max([common(w, x) for j, x in enumerate(words) if ids[j] < ids[i]], default=0)


# ---- packing


def test_packing_is_gapless_and_tight(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "x " * 5000), (-4, "<|endoftext|> it's\n\n  two")], "doc_id bigint, text string"))
    rows = packing.pack(packing.token_pieces(docs, queries.tokenizer_path()), docs.count()).collect()
    t = Tokenizer.from_file(queries.tokenizer_path())
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [i for x in own for i in np.frombuffer(bytes(x.ids), "<u4").tolist()] == ids
        assert all(zlib.crc32(bytes(x.ids)) == x.ids_crc32 and x.length <= 2048 for x in own)
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.01 * -(-sum(x.length for x in rows) // 2048) + 1
    parts = packing.token_pieces(docs, queries.tokenizer_path(), with_ids=False)
    plain = packing.pack(parts, packing.most_pieces(docs), dissolve=False)
    assert len(by) <= plain.select("sequence_id").distinct().count() <= 1.02 * len(by) + 1
    assert packing.most_pieces(docs) >= len(rows)
    empty = docs.where("false")
    assert packing.pack(packing.token_pieces(empty, queries.tokenizer_path()), packing.most_pieces(empty)).count() == 0


def test_of_a_long_document_the_first_piece_is_the_shorter_one(spark):
    docs = spark.createDataFrame([(1, "x " * 5000), (2, "a b"), (3, None), (4, "")], "doc_id bigint, text string")
    rows = packing.token_pieces(docs, queries.tokenizer_path(), size=64).collect()
    for doc in (1, 2, 3, 4):
        own = sorted((x for x in rows if x.doc_id == doc), key=lambda x: x.piece)
        total = sum(x.length for x in own)
        assert [x.length for x in own] == [total % 64 or 64, *[64] * (len(own) - 1)]
        assert [x.start for x in own] == [0, *range(own[0].length, total, 64)]
    whole = packing.token_pieces(docs.where("doc_id = 1"), queries.tokenizer_path(), size=sum(x.length for x in rows if x.doc_id == 1)).collect()
    assert [(x.piece, x.start) for x in whole] == [(0, 0)]


def test_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    r = random.Random(6)
    letters = "ab'sdtrev lm  \n\t\r\u00a0\u3000éß12٣½.,!<|endoftext|>_-漢🙂\u0301"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    encoder = packing.Encoder(queries.tokenizer_path())
    assert encoder.fast is not None
    assert encoder.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_sum_of_squares_choice():
    sequence, offset = packing.sum_of_squares(np.array([6, 5, 4, 5]), 10)
    assert len(set(sequence)) == 2 and sorted(offset) == [0, 0, 5, 6]


def test_sum_of_squares_by_definition():
    """Each piece, longest first, where the squared counts of gaps become smallest; the tightest of equals."""
    r = random.Random(5)
    for size in (7, 20):
        lengths = [r.randint(1, size) for _ in range(120)]
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            def squares(b):
                gaps = [size - x for x in b if x < size]
                return sum(gaps.count(g) ** 2 for g in set(gaps))

            tries = [[*bins, n]] + [[*bins[:i], bins[i] + n, *bins[i + 1 :]] for i in range(len(bins)) if bins[i] + n <= size]
            gap = [size] + [size - bins[i] for i in range(len(bins)) if bins[i] + n <= size]
            bins = tries[min(range(len(tries)), key=lambda i: (squares(tries[i]), gap[i]))]
        sequence, offset = packing.sum_of_squares(np.array(lengths), size)
        assert sorted(np.bincount(sequence, lengths).astype(int)) == sorted(bins)


# ---- fingerprints


def scanned_anchors(text, k=fingerprints.K, s=fingerprints.S):
    """Offsets of closed syncmers by their definition, k-mer by k-mer."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < k:
        return [0] if len(data) else []
    inner = fingerprints.mix(fingerprints.kmer_hashes(data, s)[0]).tolist()
    parts = [inner[i : i + k - s + 1] for i in range(len(data) - k + 1)]
    return [i for i, p in enumerate(parts) if min(p) in (p[0], p[-1])] or [0]


def matched_share(a, b):
    """Longest common subsequence by table, over anchors with how often they came before."""
    a, b = ([(x, s[:i].count(x)) for i, x in enumerate(s)] for s in (a, b))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    n = best[-1][-1]
    return 1.0 if a == b else n / (len(a) + len(b) - n)


def hex_words(f):
    return [f[i : i + 8] for i in range(0, len(f), 8)]


def test_fingerprints(spark):
    texts = corpus(7, 30)
    texts[3] = "ab" * 200  # every k-mer again and again
    rows = {r.doc_id: r for r in fingerprints.fingerprints_with_edits(table(spark, texts).repartition(4), bucket_rows=7).collect()}
    assert len(rows) == len(texts)
    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        following = whole[i - 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].anchor_offsets == scanned_anchors(t.encode())
        assert len(hex_words(rows[i].edited_fingerprint)) == len(scanned_anchors(edited.encode()))
        if len(t) < 900:
            mine = hex_words(rows[i].fingerprint)
            assert rows[i].near_next == matched_share(mine, hex_words(rows[(i - 1) % len(whole)].fingerprint))
            assert rows[i].near_edited == matched_share(mine, hex_words(rows[i].edited_fingerprint))
        if t == following:
            assert rows[i].near_next == 1
    same = {}
    for i, t in enumerate(whole):
        assert same.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint
    assert fingerprints.fingerprints_with_edits(table(spark, []).where("false")).count() == 0


def test_fingerprint_ranges_with_ties_and_no_ids(spark):
    rows = [(None, f"text {i} without a number") for i in range(40)] + [(7, f"text {i} of seven") for i in range(40)] + [(7, "same")] * 9
    out = fingerprints.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket_rows=5).collect()
    assert len(out) == 89 and sum(r.doc_id is None for r in out) == 40
    assert sum(r.near_next == 1 for r in out) >= 8  # of nine equal rows, eight are followed by another
    assert fingerprints.bucket_count(10**10, 8000) == 200_000 and fingerprints.bucket_count(10**6, 8000) == 125


def test_very_long_text_keeps_all_its_anchors(spark):
    text = " ".join(f"word{i * i % 7919}" for i in range(150_000))
    (row,) = fingerprints.fingerprints_with_edits(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert len(row.anchor_offsets) == len(row.fingerprint) // 8 > len(text) // 20 and row.near_next == 1


def test_likeness_follows_edits():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)).encode()
    f = lambda t: fingerprints.anchors_of(t)[1]
    assert fingerprints.likeness(f(text), f(text[:100] + b"zzz" + text[103:])) > 0.9
    other = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)).encode()
    assert fingerprints.likeness(f(text), f(other)) < 0.1
    assert np.diff(fingerprints.anchors_of(text)[0]).max() <= fingerprints.K - fingerprints.S + 1


# ---- decontamination


def test_decontamination_by_definition(spark):
    r = random.Random(4)
    vocab = ["ab", "C", "dé", "7", "x"]
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (1, 3, 13, 14, 20, 30, 12)] + ["", None, "!!"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", "--", items[5] + " und mehr", items[3].upper(), "zz " * 300 + items[2]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for limit in (1 << 20, 30):
        rows = {x.doc_id: x for x in decontam.find_hits(table(spark, texts), bench, block_words=limit).withColumn("c", decontam.is_contaminated()).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for k, item in enumerate(items):
                v = words(item)
                n = min(13, len(v))
                wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) in wins:
                        hit |= {*range(j, j + n)}
                        found.add(str(k))
            got = rows[i]
            assert (got._hits.n_words, {p for s in got._hits.spans for p in range(s.start, s.end)}, got._hits["items"]) == (len(w), hit, sorted(found))
            assert got.c == (bool(hit) and 20 * len(hit) >= len(w))
    clean = {x.doc_id: x.text for x in decontam.remove_spans(table(spark, texts), bench).collect()}
    assert clean[43].strip() == "und mehr" and clean[42] == "--" and clean[40] is None
    kept = {x.doc_id for x in decontam.decontaminate(table(spark, texts), bench).collect()}
    assert kept == {i for i, x in rows.items() if not x.c}
    assert decontam.find_hits(table(spark, texts), bench.where("false")).where("size(_hits.spans) > 0").count() == 0


# ---- near duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(9)
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three"]
    for _ in range(12):
        w = [r.choice("abcdefghijklmnop") + str(r.randrange(50)) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 9)):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = "neu" + str(r.randrange(999))
    r.shuffle(texts)
    sizes, roots = brute_components(texts)
    docs = table(spark, texts)
    rows = {x.doc_id: x for x in minhash.near_duplicates(docs.unionByName(docs.limit(3))).dropDuplicates(["doc_id"]).collect()}
    assert [(rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(zip(sizes, roots))]
    kept = minhash.drop_near_duplicates(docs)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(roots)) and kept.columns == docs.columns


def test_near_duplicates_leave_one_row_of_each_group(spark):
    a = [" ".join([*(f"a{j}" for j in range(100)), f"tail{i}"]) for i in range(3)]
    b, c, d = (" ".join(f"{x}{j}" for j in range(30)) for x in "bcd")
    rows = [(1, a[0]), (1, a[0]), (1, a[0]), (1, a[1]), (2, a[2]), (1, b), (7, b), (None, c), (None, c), (None, c), (None, d), (None, d + " more"), (5, d), (None, None), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id or -1, r.text or "") for r in minhash.drop_near_duplicates(docs).collect())
    group = [x for x in got if x[1] in a]
    assert len(group) == 1 and group[0][0] == 1 and group[0][1] in a[:2]
    assert [x for x in got if x not in group] == sorted([(1, b), (-1, c), (5, d), (-1, ""), (-1, ""), (9, ""), (9, "")])


def test_near_duplicates_chain_and_crowd(spark):
    """A long chain of links and a crowd of near copies, none of which equals another."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[i:], *(f"v{j}" for j in range(i))]) for i in range(0, 120, 4)]
    texts += [" ".join([*(f"u{j}" for j in range(100)), f"tail{i}"]) for i in range(150)]
    _, roots = brute_components(texts)
    r = random.Random(8)
    words = [f"x{i}" for i in range(80)]
    for _ in range(60):  # near copies, some of them linked to no other
        w = list(words)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = f"y{r.randrange(999)}"
        texts.append(" ".join(w))
    _, roots = brute_components(texts)
    for block in (4096, 7):
        rows = {x.doc_id: x.component_id for x in minhash.near_duplicates(table(spark, texts), block=block).collect()}
        assert [rows[i] for i in range(len(texts))] == roots
    assert minhash.near_duplicates(table(spark, []).where("false")).count() == 0


def boilerplate(n, common, own, seed=3):
    """n texts of one passage of ``common`` words and ``own`` words each of their own."""
    r = random.Random(seed)
    return [[*(f"c{j}" for j in range(common)), *(f"o{r.randrange(1 << 40)}" for _ in range(own))] for _ in range(n)]


def test_near_duplicates_in_buckets_of_unlike_members(spark):
    """Boilerplate of two thirds to four fifths of each text: its members share bands and aren't linked,
    but planted pairs and texts of nothing but boilerplate are."""
    r = random.Random(5)
    words = boilerplate(220, 120, 60) + boilerplate(60, 120, 34, 4)
    for i in range(0, 200, 5):
        w = list(words[i])
        w[120 + r.randrange(10)] = "new"
        words.append(w)
    words += [[f"c{j}" for j in range(120)], [f"c{j}" for j in range(120)] + ["x1", "x2"], [f"c{j}" for j in range(118)]]
    texts = [" ".join(w) for w in words]
    r.shuffle(texts)
    _, roots = brute_components(texts)
    assert 60 < len(set(roots)) < len(texts) - 40
    rows = {x.doc_id: x.component_id for x in minhash.near_duplicates(table(spark, texts), block=8).collect()}
    assert [rows[i] for i in range(len(texts))] == roots


def crowd(spark, words, block=8):
    """Members of the buckets that these texts share, none of them joined yet; their sets and the sets' table."""
    from specmine.llm.common import Scratch

    sets = minhash.shingle_sets([" ".join(w).encode() for w in words])
    scratch = Scratch(spark, "crowd")
    reps = scratch.keep(spark.createDataFrame([(i, minhash.signature(x).tobytes()) for i, x in enumerate(sets)], "rep bigint, sig binary"))
    full = scratch.keep(spark.createDataFrame([(i, x.astype("<u8").tobytes()) for i, x in enumerate(sets)], "rep bigint, shingles binary"))
    placed = minhash.banded(reps).select("bucket", "rep", F.col("rep").alias("root"))
    return scratch.keep(minhash.split(placed, reps, full, scratch, block)), sets, full


def test_rows_of_a_crowded_bucket_grow_with_its_members(spark):
    def rows(n):
        blocks = minhash.in_blocks(crowd(spark, boilerplate(n, 120, 60))[0], 8)
        groups = [r["count"] for r in blocks.groupBy("bucket", "blk", "prb").count().collect()]
        return sum(groups), max(groups)

    (few, _), (many, largest) = rows(500), rows(2000)
    assert many < 6 * few and largest < 64


def test_recall_of_further_minima(spark):
    """Pairs of 0.75 to 0.8 whose boilerplate alone is below the threshold, in buckets that are split."""
    words = boilerplate(400, 120, 40)
    for i in range(200):  # the last words are others
        words.append([*words[i][: 148 + i % 4], *(f"p{i}.{j}" for j in range(12 - i % 4))])
    members, sets, full = crowd(spark, words)
    assert members.where("quiet").select("rep").distinct().count() == len(words)
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    linked = {(i, 400 + i) for i in range(200) if jaccard(sets[i], sets[400 + i]) >= 0.75}
    share = 0.75 - 4 * (0.75 * 0.25 / 112) ** 0.5
    close = minhash.involved(members, share, 8)
    links = minhash.cross_links(members.join(close, ["bucket", "rep"]).join(full, "rep"), share, 75, 8)
    found = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    assert len(linked) > 150 and found <= linked and len(found) >= 0.99 * len(linked)


def links_of(spark, words):
    """Links between members of buckets that are split, and those of brute force."""
    members, sets, full = crowd(spark, words)
    share = 0.75 - 4 * (0.75 * 0.25 / 112) ** 0.5
    close = minhash.involved(members, share, 8)
    links = minhash.cross_links(members.join(close, ["bucket", "rep"]).join(full, "rep"), share, 75, 8)
    n = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array(list(map(len, sets)))
    a, b = np.nonzero(np.triu(100 * n >= 75 * (size[:, None] + size - n), 1))
    return {tuple(sorted((r.a, r.b))) for r in links.collect()}, set(zip(a.tolist(), b.tolist())), members


def test_no_link_of_a_crowded_bucket_is_lost(spark):
    """Pairs that have a single shingle in common beside boilerplate that is just below 6/7 of each."""
    words = []
    for i in range(90):
        words += [[*(f"c{j}" for j in range(144)), f"s{i}", *(f"o{i}.{k}.{j}" for j in range(23))] for k in range(2)]
    found, linked, members = links_of(spark, words)
    assert linked == {(2 * i, 2 * i + 1) for i in range(90)} and found == linked
    assert members.where("quiet").select("rep").distinct().count() == len(words)


def test_links_of_crowded_buckets_of_mixed_members(spark):
    """Boilerplate of some half to nine tenths of each text, in part left out, and pairs, threes and fours about the threshold."""
    r = random.Random(12)
    words = []
    for i in range(70):
        own = [f"o{i}.{j}" for j in range(r.choice([0, 8, 16, 24, 40, 90]))]
        base = [f"c{j}" for j in range(r.randrange(3), 120 - r.randrange(3))]
        for _ in range(r.randint(1, 4)):
            w = [*base, *own]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"n{r.randrange(1 << 40)}"
            words.append([*w, *(f"e{r.randrange(1 << 40)}" for _ in range(r.randint(0, 12)))])
    found, linked, _ = links_of(spark, words)
    group = lambda pairs: sorted(sorted(x) for x in joined_groups(pairs, len(words)))
    assert found <= linked and group(found) == group(linked) and len(linked) > 60


def joined_groups(pairs, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


# ---- language


def test_language_held_out_accuracy(spark):
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, good = rows.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and good / n > 0.97


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and it was fat" if i % 2 else "der hund und die katze sind nicht hier", "en" if i % 2 else "de") for i in range(40)], "doc_id bigint, text string, lang string")
    sample = langid.sample_by_language(docs, learn=crc_mod(F.col("doc_id"), 3) != 1)
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "12 !!", 5.0), (4, "Der Hund! " * 3000, 5.0), (None, "the cat", 5.0)], "doc_id bigint, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, sample).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "de" and got[None][0] == "en"
    assert {r.lang_pred for r in langid.identify(odd, []).collect()} == {"und"}


def test_cross_parsing_counts_longest_matches():
    parser = langid.CrossParser([("a", b"abcab"), ("b", b"xyz")])

    def count(text, sample):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    texts = ["abcabcab", "xyzab", "abxq", "qq", "aqa", ""]
    r = random.Random(2)
    texts += ["".join(r.choice("abcxyzq") for _ in range(r.randint(1, 9000))) for _ in range(20)] + ["abc" * 3000, "cab" * 700 + "q"]
    got = parser.phrases([t.encode() for t in texts]) * np.array([[len(t)] for t in texts])
    assert np.allclose(got, [[count(t, "abcab"), count(t, "xyz")] for t in texts])


def test_phrases_are_whole_over_stretches(monkeypatch):
    """Long matches that run over several stretches: each falls in late or never."""
    sample = "".join(random.Random(3).choice("abcd") for _ in range(3000))
    texts = [sample[i : i + n] + sample[j : j + n] for i, j, n in ((0, 5, 2500), (100, 1, 2800), (7, 900, 40))] + ["d" + sample * 2, sample[3:999]]
    got = []
    for stretch in (1 << 20, 1024, 64, 3):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        got.append(langid.CrossParser([("a", sample.encode()), ("b", b"ab")]).phrases([t.encode() for t in texts]).tolist())
    assert got[0] == got[1] == got[2] == got[3]


# ---- other columns


def test_columns_with_clashing_names(spark):
    from specmine.llm import licenses, ngram_lm

    rows = [(1, "one two three four five six", "en", "x", "x", "x", 1), (2, "one two three four five six", None, "y", None, "y", 2), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, bucket string, kept string, rank_id bigint")
    bench = spark.createDataFrame([(1, "one two three four five six seven", "x")], "item_id bigint, text string, spans string")
    assert decontam.find_hits(docs, bench).drop("_hits").columns == docs.columns
    odd = docs.withColumnsRenamed({"bucket": "_hits", "score": "_l", "kept": "_kept_row_key", "rank_id": "_cut"})
    for out in (decontam.decontaminate(odd, bench), decontam.remove_spans(odd, bench), minhash.drop_near_duplicates(odd), licenses.scan(odd).drop("licenses", "sentence_ids")):
        assert out.columns == odd.columns and {r._hits for r in out.collect()} <= {"x", "y", None}
    assert sorted(r.bucket or "" for r in decontam.decontaminate(docs, bench).collect()) == ["", "", "x"]
    assert sorted(r.kept or "" for r in minhash.drop_near_duplicates(docs).collect()) == ["", "x"]
    assert {r.score for r in langid.identify(docs, []).collect()} == {0.0}
    assert suffix_dedup.remove_repeats(docs).count() == 3 and licenses.scan(docs).count() == 3
    assert packing.pack(packing.token_pieces(docs, queries.tokenizer_path()), 3).count() == 3
    assert fingerprints.fingerprints_with_edits(docs).count() == 3
    assert [r.n_tokens for r in ngram_lm.score(docs, ngram_lm.train(docs)).orderBy("n_tokens").collect()] == [1, 7, 7]


def test_hot_windows_go_to_a_bucket_once_a_chunk(spark):
    """A passage that all documents share between unlike texts: rows of one window don't grow with the documents."""
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = letters(108)
    texts = [letters(190) + passage + letters(190) for _ in range(3000)]
    rows = suffix_dedup.keyed(table(spark, texts), "doc_id", "text").withColumn("rank_id", F.col("doc_id")).coalesce(1)
    n, k = 64, 22
    settled = suffix_dedup._settle(suffix_dedup._send(rows, n, 50, k))
    wanted = settled.where("wanted").groupBy(F.col("k").alias("_w"), "rank").agg(F.collect_set("payload").alias("blobs"))
    asked = rows.join(wanted, (rows._k == wanted._w) & (rows.rank_id == wanted["rank"])).select("_k", "rank_id", "text", "blobs").coalesce(1)
    sent = suffix_dedup._contents(asked, n, 50)
    assert sent.where("settled = 0").groupBy("content").count().agg(F.max("count")).first()[0] <= 2
    data, gone = brute_removed(texts)
    got = {x.doc_id: bytes(x.kept) for x in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    assert all(got[i] == bytes(b for b, x in zip(d, g) if not x) for i, (d, g) in enumerate(zip(data, gone)))
