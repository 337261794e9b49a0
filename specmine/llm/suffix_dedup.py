"""Removal of repeated passages by longest-previous-factor arrays.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document
with a smaller id. Sorting every suffix of the corpus would move the corpus many times over,
so suffixes are dealt by a content-defined anchor first:

1. Every window of ``length`` bytes has a least k-mer hash (k = 22 for 50). Neighbouring windows with
   the same one form a stretch of 50 to 78 bytes. Equal windows have equal anchors, so equal
   strings always meet in the bucket of their anchor; a stretch is sent as two hashes, 112 bits
   in all (in 10**13 stretches two unlike ones agree with a chance of about 1e-8).
2. In a bucket, a stretch that equals one of a smaller document is a run of equal suffixes, whose
   longest previous factors cover it: it is removed whole. Stretches of one anchor that differ are
   asked for by content.
3. For those, a suffix array of their windows is built from the bytes, with the longest common
   prefixes of neighbours. The nearest earlier and later suffix of a smaller document (previous and
   next smaller value) give each suffix's longest previous factor; one of ``length`` bytes or
   more is a repeat.
4. The intervals found are joined to the texts and cut out.

Stretches that repeat within a task's own chunk are settled there and sent once, so a passage
or document that fills a third of the table reaches its bucket once a chunk. An anchor with
``HOT`` unlike stretches in some chunk (the edge of a passage that very many documents share) is
hot: chunks send but a witness of it, no bucket gathers it, and its windows are dealt out by a hash
of their own bytes in step 3, where equal ones still meet: of equal windows of a chunk only those of the smallest
document, as the others are settled there. All buckets grow in number with the input.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; of rows with
equal ids none is smaller; a null id comes after all others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from specmine.llm.common import LAST_ID, as_bytes, keyed, kmer_hashes, materialize, mix, pieces, sliding_min, text_bytes

LENGTH = 50
SEGMENT = 1 << 16  # window starts of one segment of a text
HOT = 64  # unlike stretches of one anchor in one chunk of 6 MB
HOT_FLAG = np.uint64(1 << 63)
LOW48 = np.uint64((1 << 48) - 1)
FOUND = np.dtype([("pos", "<u4"), ("len", "u1")])
WANTED = np.dtype([("pos", "<u4"), ("len", "u1"), ("kmer", "<u8")])


def stretches(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size in bytes, anchor and content hash of the stretches of concatenated segments."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if len(data) < length:
        return none
    w = length - k + 1
    (h,) = kmer_hashes(data, k)
    h = mix(h)
    least = sliding_min(h, w)
    valid = np.ones(len(least) + 1, bool)
    valid[-1] = False
    for e in ends[ends < len(least) + length].tolist():
        valid[max(0, e - length + 1) : e] = False
    same = np.empty(len(least), bool)
    same[-1] = False
    same[:-1] = (least[1:] == least[:-1]) & valid[1:-1]
    first = np.flatnonzero(valid[:-1] & ~(np.concatenate(([False], same[:-1] & valid[:-2]))))
    last = np.flatnonzero(valid[:-1] & ~same)
    if not len(first):
        return none
    count = last - first + 1
    if count.max() > w:  # a k-mer that repeats at once, as in runs of one byte
        times = -(-count // w)
        rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, count = np.repeat(first, times) + rank * w, np.minimum(np.repeat(count, times) - rank * w, w)
    size = count + length - 1
    content = h[first]
    for at in (first + k, first + size - 2 * k, first + size - k):  # together they cover the stretch
        content = content * np.uint64(0x9E3779B97F4A7C15) + h[at]
    return first, size, least[first], mix(content + size.astype(np.uint64))


def _send(rows: DataFrame, n_buckets: int, length: int, k: int) -> DataFrame:
    """Stretches of each chunk of rows: hashes by bucket, and what the chunk settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 6 << 20):
                batch = once(batch)
                texts = as_bytes(batch.column("text"))
                key, rank = batch.column("_k").to_numpy(), batch.column("rank_id").to_numpy()
                segments = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - length + 1), SEGMENT)]
                parts: list[tuple[np.ndarray, ...]] = []
                at, group, filled = 0, [], 0
                for n, (i, a) in enumerate(segments):  # about 1 MB at a time, which stays in cache
                    group.append(texts[i][a : a + SEGMENT + length - 1])
                    filled += len(group[-1])
                    if filled >= 1 << 20 or n + 1 == len(segments):
                        sizes = np.array([len(g) for g in group])
                        ends = np.cumsum(sizes)
                        first, size, kmer, content = stretches(np.frombuffer(b"".join(group), np.uint8), ends, length, k)
                        seg = np.searchsorted(ends, first, "right")
                        parts.append((seg + at, first - (ends - sizes)[seg], size, kmer, content))
                        at, group, filled = n + 1, [], 0
                seg, pos, size, kmer, content = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
                if not len(seg):
                    continue
                bucket, kmer, content = (kmer % np.uint64(n_buckets)).astype(np.int32), (kmer >> np.uint64(8)) & LOW48, content.astype("<u8")
                owner = np.array([i for i, _ in segments])
                ids = rank[owner[seg]]
                order = np.lexsort((ids, content, kmer, bucket))
                seg, pos, size, bucket, kmer, content, ids = (x[order] for x in (seg, pos, size, bucket, kmer, content, ids))
                new = np.concatenate(([True], (kmer[1:] != kmer[:-1]) | (content[1:] != content[:-1]) | (bucket[1:] != bucket[:-1])))
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                later = ids > ids[head]
                base = np.array([a for _, a in segments])
                out: list[tuple] = []

                def tell(some: np.ndarray, kind: np.dtype, n: int) -> None:
                    """A row for each document: intervals to remove (n = 0) or contents asked for (n = -1)."""
                    own = owner[seg[some]]
                    by = np.argsort(own, kind="stable")
                    blob = np.zeros(len(by), kind)
                    blob["pos"], blob["len"] = (base[seg[some]] + pos[some])[by], size[some][by]
                    if n:
                        blob["kmer"] = kmer[some][by] | HOT_FLAG
                    cut = np.flatnonzero(np.diff(own[by])) + 1
                    for i, f in zip(own[by][np.concatenate(([0], cut))].tolist(), np.split(blob, cut)):
                        out.append((int(key[i]) % n_buckets, n, int(key[i]), int(rank[i]), f.tobytes(), b""))

                if later.any():  # repeats inside the chunk
                    tell(later, FOUND, 0)
                    seg, pos, size, bucket, kmer, content = (x[~later] for x in (seg, pos, size, bucket, kmer, content))
                new = np.concatenate(([True], (kmer[1:] != kmer[:-1]) | (bucket[1:] != bucket[:-1])))
                of = np.cumsum(new) - 1
                hot = (np.bincount(of) >= HOT)[of]
                if hot.any():
                    tell(hot, WANTED, -1)
                    size = np.where(hot, 0, size)  # a witness for each hot anchor
                    seg, pos, size, bucket, kmer, content = (x[~hot | new] for x in (seg, pos, size, bucket, kmer, content))
                table = np.stack((rank[owner], key[owner]), 1).astype("<i8")
                edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    s = slice(edges[b], edges[b + 1])
                    used, seg_no = np.unique(seg[s], return_inverse=True)
                    planes = kmer[s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T  # sorted: the high bytes shrink well
                    place = (base[seg[s]] + pos[s]).astype("<u4")
                    payload = np.ascontiguousarray(planes).tobytes() + content[s].tobytes() + (place >> 16).astype("<u2").tobytes() + (place & 0xFFFF).astype("<u2").tobytes() + size[s].astype(np.uint8).tobytes() + seg_no.astype("<u4" if len(used) > 65535 else "<u2").tobytes()
                    out.append((b, edges[b + 1] - edges[b], 0, 0, payload, table[used].tobytes()))
                for i in range(0, len(out), 500):
                    cols = list(zip(*out[i : i + 500]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "n", "k", "rank", "payload", "segments"])

    return rows.mapInArrow(run, "bucket int, n int, k bigint, rank bigint, payload binary, segments binary")


def once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without rows whose key came before: rows equal in id and text get equal results."""
    key = np.stack((batch.column("_k").to_numpy(), batch.column("rank_id").to_numpy()), 1)
    first = np.unique(key, axis=0, return_index=True)[1]
    return batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))


def _blobs_by_row(keys: np.ndarray, ranks: np.ndarray, values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(key, rank, values as bytes) of each row."""
    if not len(keys):
        return []
    by = np.lexsort((keys, ranks))
    keys, ranks, values = keys[by], ranks[by], values[by]
    cut = np.flatnonzero((keys[1:] != keys[:-1]) | (ranks[1:] != ranks[:-1])) + 1
    first = np.concatenate(([0], cut))
    return list(zip(keys[first].tolist(), ranks[first].tolist(), [x.tobytes() for x in np.split(values, cut)]))


def rows_of(keys: np.ndarray, ranks: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    k, rank, blobs = zip(*_blobs_by_row(keys, ranks, found))
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(rank, pa.int64()), pa.array(blobs, pa.binary())], ["k", "rank", "payload"])


def _settle(sent: DataFrame) -> DataFrame:
    """Of each bucket: intervals to remove (wanted = false) and contents that must be compared."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, bytes]] = []
        asked: list[tuple[int, int, bytes]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for n, k, rank, payload, segments in zip(*(batch.column(c).to_pylist() for c in ("n", "k", "rank", "payload", "segments"))):
                if n < 1:
                    (asked if n else done).append((k, rank, payload))
                    continue
                raw = np.zeros((n, 8), np.uint8)
                raw[:, :6] = np.frombuffer(payload, np.uint8, 6 * n).reshape(6, n).T
                table = np.frombuffer(segments, "<i8").reshape(-1, 2)
                seg = np.frombuffer(payload, "<u4" if len(payload) - 19 * n == 4 * n else "<u2", n, 19 * n)
                pos = np.frombuffer(payload, "<u2", n, 14 * n).astype(np.uint32) << 16 | np.frombuffer(payload, "<u2", n, 16 * n)
                parts.append((raw.view("<u8")[:, 0], np.frombuffer(payload, "<u8", n, 6 * n), pos, np.frombuffer(payload, np.uint8, n, 18 * n), table[seg, 0], table[seg, 1]))
        names = ["k", "rank", "wanted", "payload"]
        kmer = np.zeros(0, np.uint64)
        if parts:
            kmer, content, pos, size, ids, keys = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((ids, content, kmer))
            k2 = kmer[order]
            lone = np.concatenate(([True], k2[1:] != k2[:-1])) & np.concatenate((k2[1:] != k2[:-1], [True]))
            order = order[~lone]  # most anchors occur once
            kmer, content, pos, size, ids, keys = (x[order] for x in (kmer, content, pos, size, ids, keys))
        if len(kmer):
            at = np.arange(len(kmer))
            new_kmer = np.concatenate(([True], kmer[1:] != kmer[:-1]))
            new = new_kmer | np.concatenate(([True], content[1:] != content[:-1]))
            start = np.flatnonzero(new_kmer)
            group = np.cumsum(new_kmer) - 1
            # anchors that are hot in some chunk are settled by their windows, whatever the chunk
            hot = (np.minimum.reduceat(size, start) == 0)[group]
            head = np.maximum.accumulate(np.where(new, at, 0))
            later = (ids > ids[head]) & ~hot
            found = np.zeros(int(later.sum()), FOUND)
            found["pos"], found["len"] = pos[later], size[later]
            done += _blobs_by_row(keys[later], ids[later], found)
            # anchors with several contents, in more than one document
            several = np.add.reduceat(new.astype(np.int64), start) > 1
            spread = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
            ask = ((several & spread)[group] & ~later | hot) & (size > 0)
            wanted = np.zeros(int(ask.sum()), WANTED)
            wanted["pos"], wanted["len"], wanted["kmer"] = pos[ask], size[ask], kmer[ask] | np.where(hot[ask], HOT_FLAG, np.uint64(0))
            asked += _blobs_by_row(keys[ask], ids[ask], wanted)
        for rows, flag in ((done, False), (asked, True)):
            for i in range(0, len(rows), 5000):
                k, rank, blobs = zip(*rows[i : i + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(rank, pa.int64()), pa.array([flag] * len(k)), pa.array(blobs, pa.binary())], names)

    return sent.groupBy("bucket").applyInArrow(run, "k bigint, rank bigint, wanted boolean, payload binary")


SENT = ["bucket", "rank_id", "k", "pos", "settled", "content"]


def _hot_windows(asked: list[tuple[bytes, int, int, np.ndarray]], n_buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of the windows asked for at hot anchors (text, rank, key, wanted places of each row of a chunk): of equal
    windows those of the smallest document go to the bucket of their bytes' hash; the others are settled, and go as runs
    of windows (empty content, the number of windows behind the place) to a bucket of their row's."""
    data = np.frombuffer(b"".join(t for t, *_ in asked), np.uint8)
    base = np.cumsum([0, *[len(t) for t, *_ in asked]])
    row = np.repeat(np.arange(len(asked)), [len(w) for *_, w in asked])
    want = np.concatenate([w for *_, w in asked])
    n = want["len"].astype(np.int64) - length + 1
    at = base[np.repeat(row, n)] + np.repeat(want["pos"].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.unique(at)  # stretches of one row may share windows
    row = np.searchsorted(base, at, "right") - 1
    rank, key = np.array([r for _, r, _, _ in asked])[row], np.array([k for _, _, k, _ in asked])[row]
    h = mix(kmer_hashes(data, length)[0])[at]
    order = np.lexsort((rank, h))
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    head = np.empty(len(at), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    later = rank > rank[head]
    view = np.lib.stride_tricks.as_strided(data, (len(data) - length + 1, length), (1, 1))
    for i in range(0, len(at), 1 << 16):  # windows that share a hash and nothing else are sent
        later[i : i + (1 << 16)] &= (view[at[i : i + (1 << 16)]] == view[at[head[i : i + (1 << 16)]]]).all(axis=1)
    bucket, pos = (h % np.uint64(n_buckets)).astype(np.int64), at - base[row]
    sent = np.flatnonzero(~later)
    for i in range(0, len(sent), 20_000):
        some = sent[i : i + 20_000]
        body = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(0, length * len(some) + 1, length, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(view[at[some]]).tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[some]), pa.array(rank[some]), pa.array(key[some]), pa.array(pos[some]), pa.array(np.zeros(len(some), np.int32)), body], SENT)
    told = np.flatnonzero(later)
    if len(told):
        new = np.concatenate(([True], (row[told][1:] != row[told][:-1]) | (np.diff(at[told]) > 1)))
        within = np.arange(len(told)) - np.maximum.accumulate(np.where(new, np.arange(len(told)), 0))
        start = np.flatnonzero(within % (255 - length) == 0)  # an interval's length is a byte
        count = np.diff([*start.tolist(), len(told)])
        some = told[start]
        for i in range(0, len(some), 20_000):
            j = some[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[j] % n_buckets), pa.array(rank[j]), pa.array(key[j]), pa.array(pos[j]), pa.array(count[i : i + 20_000].astype(np.int32)), pa.array([b""] * len(j), pa.binary())], SENT)


def _contents(texts: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """The bytes of the stretches that were asked for, by bucket of their anchors; those of hot
    anchors window by window, each once a chunk, by bucket of the window's own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 6 << 20):
                batch = once(batch)
                out: list[tuple] = []
                asked: list[tuple[bytes, int, int, np.ndarray]] = []
                for text, key, rank, blobs in zip(as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("_k", "rank_id", "blobs"))):
                    want = np.unique(np.frombuffer(b"".join(blobs), WANTED))
                    hot = want["kmer"] >= HOT_FLAG
                    few = want[~hot]
                    bucket = (few["kmer"] % np.uint64(n_buckets)).astype(np.int64)
                    for b, pos, size in zip(bucket.tolist(), few["pos"].tolist(), few["len"].tolist()):
                        out.append((b, rank, key, pos, 0, text[pos : pos + size]))
                    if hot.any():
                        asked.append((text, rank, key, want[hot]))
                if asked:
                    yield from _hot_windows(asked, n_buckets, length)
                for i in range(0, len(out), 20000):
                    cols = list(zip(*out[i : i + 20000]))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], SENT)

    return texts.mapInArrow(run, "bucket bigint, rank_id bigint, k bigint, pos bigint, settled int, content binary")


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and the common prefix
    of each with the one before it (0 for the first)."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - depth + 1, depth), (1, 1))
    rows = np.ascontiguousarray(view[starts])
    order = np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")
    lcp = np.zeros(len(starts), np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        lcp[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return order, lcp


def longest_previous_factors(ids: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in order, with their documents' ids: the longest prefix shared with a suffix
    of a smaller id. The nearest smaller value before (and after) is found by hopping over
    neighbours' own nearest ones, keeping the least common prefix on the way."""
    best = np.zeros(len(ids), np.int64)
    for back in (False, True):
        value = ids[::-1] if back else ids
        common = (np.concatenate((lcp[1:], [0]))[::-1] if back else lcp).copy()
        to = np.arange(len(ids)) - 1
        while True:
            wait = np.flatnonzero((to >= 0) & (common > 0))
            wait = wait[value[to[wait]] >= value[wait]]
            if not len(wait):
                break
            over = to[wait]
            common[wait] = np.minimum(common[wait], common[over])
            to[wait] = to[over]
        common[to < 0] = 0
        best = np.maximum(best, common[::-1] if back else common)
    return best


def _factors(contents: DataFrame, length: int) -> DataFrame:
    """Intervals whose windows have a previous factor of ``length`` bytes."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        told = table.filter(pc.greater(table["settled"], 0))
        table = table.filter(pc.equal(table["settled"], 0))
        if told.num_rows:
            runs = np.zeros(told.num_rows, FOUND)
            runs["pos"], runs["len"] = told["pos"].to_numpy(), told["settled"].to_numpy() + length - 1
            yield rows_of(told["k"].to_numpy(), told["rank_id"].to_numpy(), runs)
        if not table.num_rows:
            return
        body = table["content"].to_pylist()
        ids, keys, pos = (table[c].to_numpy() for c in ("rank_id", "k", "pos"))
        sizes = np.fromiter(map(len, body), np.int64, len(body))
        data = np.frombuffer(b"".join(body), np.uint8)
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(body)), windows)
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        order, lcp = suffix_order(data, (np.cumsum(sizes) - sizes)[owner] + within, length)
        lpf = np.zeros(len(owner), np.int64)
        lpf[order] = longest_previous_factors(ids[owner[order]], lcp)
        hit = np.flatnonzero(lpf >= length)
        if len(hit):
            gap = np.concatenate(([True], (owner[hit][1:] != owner[hit][:-1]) | (np.diff(within[hit]) > 1)))
            first, last = hit[gap], hit[np.concatenate((gap[1:], [True]))]
            found = np.zeros(len(first), FOUND)
            found["pos"], found["len"] = pos[owner[first]] + within[first], within[last] - within[first] + length
            yield rows_of(keys[owner[first]], ids[owner[first]], found)

    return contents.groupBy("bucket").applyInArrow(run, "k bigint, rank bigint, payload binary")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(k, rank, payload): the intervals to remove of each row (a hash of id and text, and the id),
    in any number of rows."""
    rows = keyed(docs, id_col, text_col).withColumn("rank_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    if not 25 <= length <= 160:
        raise ValueError("length must be from 25 to 160 bytes")
    k = length * 11 // 25
    n_buckets = max(1, -(-text_bytes(rows) // bucket_bytes))
    unique = rows.select("_k", "rank_id", "text")
    settled = materialize(_settle(_send(unique, n_buckets, length, k)), "repeats")
    wanted = settled.where("wanted").groupBy("k", "rank").agg(F.collect_set("payload").alias("blobs"))
    texts = unique.join(wanted.hint("shuffle_hash"), (unique._k == wanted.k) & (unique.rank_id == wanted["rank"])).select("_k", "rank_id", "text", "blobs")
    factors = _factors(_contents(texts, 8 * n_buckets, length), length)
    out = settled.where("not wanted").select("k", "rank", "payload").unionByName(materialize(factors, "factors"))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """doc_id, kept (the remaining bytes), spans (maximal removed runs, in bytes), n_bytes, and a
    struct ``row`` of the columns named in ``keep``."""
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("_null_text"), *[F.col(f"`{c}`") for c in keep or []])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), row.alias("row")).withColumns({"_k": F.xxhash64("doc_id", "text"), "_rank": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))})
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length)
    spans = spans.groupBy("k", "rank").agg(F.collect_set("payload").alias("blobs"))
    joined = rows.join(spans.hint("shuffle_hash"), (rows._k == spans.k) & (rows._rank == spans["rank"]), "left").select("doc_id", "row", "text", "blobs")
    schema = joined.select("doc_id", "row").schema.add("kept", BinaryType()).add("spans", ArrayType(StructType().add("start", LongType()).add("end", LongType()))).add("n_bytes", LongType())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 6 << 20):
                texts = as_bytes(batch.column("text"))
                kept, removed = [], []
                for text, blobs in zip(texts, batch.column("blobs").to_pylist()):
                    if not blobs:
                        kept.append(text)
                        removed.append([])
                        continue
                    found = np.frombuffer(b"".join(blobs), FOUND)
                    start = found["pos"].astype(np.int64)
                    end = start + found["len"]
                    by = np.argsort(start, kind="stable")
                    start, reach = start[by], np.maximum.accumulate(end[by])
                    new = np.concatenate(([True], start[1:] > reach[:-1]))
                    a, b = start[new], reach[np.concatenate((new[1:], [True]))]
                    kept.append(b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)])))
                    removed.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(kept, pa.binary()), pa.array(removed, kind), pa.array(list(map(len, texts)), pa.int64())], ["doc_id", "row", "kept", "spans", "n_bytes"])

    return joined.mapInArrow(run, schema)
