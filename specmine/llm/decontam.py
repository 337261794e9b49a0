"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are maximal runs of digits, lower-cased letters and non-ASCII characters. The items'
words make one automaton; every document's words run through it, which gives the longest
match ending at each word. A match of ``window`` words (or of a whole shorter item) is a hit.

Items are streamed in blocks of a bounded number of words, so what the driver holds, what is sent to the
executors and the automaton that each Python worker builds (some 200 MB) are bounded for any number of items. Each block is a pass over the rows without a
shuffle; between two passes the rows are written to the shared folder, and the block before is
given up.

Defined results: null or empty text has no words, no hits; an item without words never
matches; repeated items each count; repeated documents are judged one by one; empty tables
give empty results (no items: nothing is hit).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import as_bytes, materialize, pieces, unused

WORD_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
BLOCK_WORDS = 150_000  # of items in one automaton: up to twice as many states, of about 700 bytes each


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class ItemAutomaton:
    """Suffix automaton over the word sequences of all items.

    ``hits(ids)`` gives the hit intervals of words and the items whose windows occur.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, words in items if words]
        sequences = [words for _, words in items if words]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for words in sequences]
        self.shortest = min([window, *map(len, coded)])
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int]] = []
        for k, seq in enumerate(coded):
            last = 0
            for c in seq:
                last = self._extend(last, c)
                ends.append((last, k))
        # items by state: an item's occurrences end in the states of its prefixes and in all they link to
        self.items: list[set[int]] = [set() for _ in self.len]
        lengths = [len(s) for s in coded]
        for v, k in ends:
            if lengths[k] >= window:
                self.items[v].add(k)
        order = sorted(range(1, len(self.len)), key=lambda v: -self.len[v])
        for v in order:
            if self.len[self.link[v]] >= window:
                self.items[self.link[v]] |= self.items[v]
        # short items that are suffixes of what a state holds, with their lengths
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(coded):
            if lengths[k] < window:
                v = 0
                for c in seq:
                    v = self.next[v][c]
                whole.setdefault(v, []).append((lengths[k], k))
        for v in reversed(order):
            self.short[v] = (*whole.get(v, ()), *self.short[self.link[v]])

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.len)
        self.len.append(self.len[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = len(self.len)
        self.len.append(self.len[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        window, nxt, link, length = self.window, self.next, self.link, self.len
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.shortest:
                continue
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    n += 1
                while v and length[link[v]] >= window:  # only the last `window` words matter
                    v = link[v]
                n = min(n, length[v])
                if n >= window:
                    spans.append((i - window, i))
                    found |= self.items[v]
                for m, k in self.short[v]:
                    if m <= n:
                        spans.append((i - m, i))
                        found.add(k)
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``limit`` words (one item at least), streamed."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        n = len(words_of(row.t.encode()))
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += n
    if block:
        yield block


_built: dict[str, ItemAutomaton] = {}


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "_hits", window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` with a struct ``out_col`` of ``n_words``, ``spans`` (hit runs of words)
    and ``items`` added; a column of that name is replaced."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    ddl = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
    out = docs.drop(out_col).withColumn(out_col, F.lit(None).cast(ddl))
    schema = out.schema
    names = [n for n in schema.names if n != out_col]
    spark = docs.sparkSession
    sent = None
    for block in chain(item_blocks(benchmark, item_col, item_text_col, block_words), [None]):
        if block is None and sent is not None:
            break
        if sent is not None:  # one more pass: the rows so far are written, and the last block is given up
            out = materialize(out, "hits")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(block or [])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if key not in _built:  # once for each worker process
                _built.clear()
                _built[key] = ItemAutomaton([(i, words_of(t.encode())) for i, t in sent.value], window)
            machine = _built[key]
            get = machine.vocabulary.get
            for whole in batches:
                for batch in pieces(whole, text_col):
                    before = batch.column(out_col).to_pylist()
                    result = []
                    for text, old in zip(as_bytes(batch.column(text_col)), before):
                        words = words_of(text)
                        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                        spans, found = machine.hits(ids) if machine.names else ([], set())
                        items = [machine.names[k] for k in found]
                        if old:
                            spans += [(s["start"], s["end"]) for s in old["spans"]]
                            items += old["items"]
                        result.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in merged(spans)], "items": sorted(items)})
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(result, kind)], [*names, out_col])

        out = out.mapInArrow(run, schema)
    return out


def n_hit(hits: str = "_hits") -> F.Column:
    return F.aggregate(F.col(hits)["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(hits: str = "_hits") -> F.Column:
    """Some word is hit, and hit words are a twentieth of all words or more."""
    return (n_hit(hits) > 0) & (n_hit(hits) * 20 >= F.col(hits)["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents; the others stay as they are."""
    hits = unused(docs, "_hits")
    return find_hits(docs, benchmark, out_col=hits, **options).where(~is_contaminated(hits)).drop(hits)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` whose contaminated texts lose their hit words; the white space between them stays."""
    hits, bad_col = unused(docs, "_hits"), unused(docs, "_cut")
    found = find_hits(docs, benchmark, text_col=text_col, out_col=hits, **options).withColumn(bad_col, is_contaminated(hits))
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for i, (found, bad) in enumerate(zip(batch.column(hits).to_pylist(), batch.column(bad_col).to_pylist())):
                if bad:
                    data = texts[i].encode()
                    flat = data.translate(WORD_TABLE)
                    inside = np.frombuffer(flat, np.uint8) != 0x20
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
                    starts, ends = edge[::2], edge[1::2]
                    kept, at = [], 0
                    for s in found["spans"]:
                        kept.append(data[at : starts[s["start"]]])
                        at = ends[s["end"] - 1]
                    texts[i] = b"".join([*kept, data[at:]]).decode()
            names = schema.names
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(n).type) if n == text_col else batch.column(n) for n in names], names)

    return found.mapInArrow(cut, schema)
