"""Removal of repeated word passages on a compacted de Bruijn graph.

A word is removed if a window of ``length`` words covers it that also starts in a document of a smaller
id. Windows are edges of the graph of token k-mers: each leads from its first ``length - 1`` words to its
last ones. No window is spelt out where neighbours can stand for it:

1. In each text, neighbouring windows with the same least seed (a hash of ``SEED`` words) are one edge,
   a token k-mer of ``length`` words or some more. Equal windows have equal seeds, so only edges whose
   seed is in two documents go on.
2. Edges of equal words (two 64-bit hashes) become one, with the smallest document that has it, its
   place there (the source coordinate), the number of its places and the edge that follows.
   An edge that always leads to the same next one, which never comes from another, has no branch:
   a join of edges with their successors finds these links, source coordinates confirm them, and
   links in a source document's order are compacted to paths.
3. Places of an edge in documents behind its first are repeats. Those of one path at one distance from
   their source are one span, if they fill it without a hole; else each stands for itself.
4. Where one seed has several unlike edges (the ends of passages), the first place of each is spelt out
   as windows, and windows meet by their own hashes.
5. Spans are joined to the texts and cut out.

Nothing is gathered by edge, seed or window: smallest documents come from partial aggregates, and
places are joined to them, where Spark splits skewed keys. Only a document's own spans are gathered.

Defined results: null text has no words; texts of fewer words lose nothing; of rows with equal
ids none is smaller; a null id comes after all others; repeated rows get equal results; columns besides
id and text are left behind, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmine.llm.common import LAST_ID, Scratch, as_bytes, keyed, materialize, mix, pieces, powers, sliding_min, word_hashes

LENGTH, SEED = 50, 16
SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
CHUNK = 4 << 20  # bytes of text that are hashed at a time
PLACES = "k bigint, rank bigint, pos int, n int, seed bigint, e1 bigint, e2 bigint, following bigint"


class Words:
    """Words of some texts, with hashes of any run of them."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        start, _, h = word_hashes(data, SPACE)
        cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        self.first = np.concatenate(([0], cut))  # of each text, and the end
        self.n = len(start)
        up, self.down = powers(self.n)
        zero = np.zeros(1, np.uint64)
        self.sums = [np.concatenate((zero, np.cumsum(x * up, dtype=np.uint64))) for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D)))]

    def hashes(self, which: int, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        sums = self.sums[which]
        return mix((sums[at + size] - sums[at]) * self.down[at] + np.asarray(size).astype(np.uint64))


def stretches(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and seed of each run of windows of one text with the same least seed."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if words.n < length:
        return none
    w = length - SEED + 1
    least = sliding_min(words.hashes(0, np.arange(words.n - SEED + 1), SEED), w)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = owner[: len(least)] == owner[length - 1 :]
    same = np.zeros(len(least), bool)  # goes on from the window before
    same[1:] = (least[1:] == least[:-1]) & inside[1:] & inside[:-1]
    first = np.flatnonzero(inside & ~same)
    if not len(first):
        return none
    goes_on = np.concatenate((same[1:], [False]))
    count = np.flatnonzero(inside & ~goes_on) - first + 1
    if count.max() > w:  # words that repeat at once
        times = -(-count // w)
        rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, count = np.repeat(first, times) + rank * w, np.minimum(np.repeat(count, times) - rank * w, w)
    return first, count, least[first]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def places(rows: DataFrame, length: int) -> DataFrame:
    """Every edge's every place: row, word at which it begins, windows, seed, hashes, first hash of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                words = Words(as_bytes(batch.column("text")))
                at, n, seed = stretches(words, length)
                if not len(at):
                    continue
                row = np.searchsorted(words.first, at, "right") - 1
                e1, e2 = words.hashes(0, at, n + length - 1), words.hashes(1, at, n + length - 1)
                following = np.zeros(len(at), np.uint64)
                following[:-1] = np.where(row[1:] == row[:-1], e1[1:], np.uint64(0))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k").take(take), batch.column("rank_id").take(take), pa.array((at - words.first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), signed(seed), signed(e1), signed(e2), signed(following)],
                    ["k", "rank", "pos", "n", "seed", "e1", "e2", "following"],
                )

    return rows.select("_k", "rank_id", "text").mapInArrow(run, PLACES)


def compacted(edges: DataFrame) -> DataFrame:
    """The edges that are in several documents, with ``head``: where their path without branches begins
    in the source document."""
    shared = edges.where("first < last")
    after = shared.select(F.col("e1").alias("_e1"), F.col("e2").alias("_e2"), F.col("n_places").alias("_n"), F.col("src").alias("_src"))
    linked = shared.where("least_next = most_next").join(
        after,
        (F.col("least_next") == F.col("_e1")) & (F.col("n_places") == F.col("_n")) & (F.col("src.k") == F.col("_src.k")) & (F.col("src.rank") == F.col("_src.rank")) & (F.col("src.pos") + F.col("src.n") == F.col("_src.pos")),
    )
    linked = linked.select(F.col("_e1").alias("e1"), F.col("_e2").alias("e2"), F.lit(True).alias("linked"))
    in_source = W.partitionBy("src.k", "src.rank").orderBy("src.pos")
    head = F.last(F.when(F.col("linked").isNull(), F.col("src.pos")), ignorenulls=True).over(in_source)
    return shared.join(linked, ["e1", "e2"], "left").select("e1", "e2", "src", head.alias("head"))


def windows(texts: DataFrame, length: int) -> DataFrame:
    """The windows of the places asked for (``want``: first window and number in one integer), by two hashes.
    Of equal windows of a chunk, those behind the smallest document are told at once (``later``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                words = Words(as_bytes(batch.column("text")))
                want = batch.column("want")
                row = np.repeat(np.arange(batch.num_rows), np.diff(want.offsets.to_numpy()))
                packed = want.flatten().to_numpy()
                n = packed & 0xFFFFFFFF
                at = np.repeat(words.first[row] + (packed >> 32), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                w1, w2 = words.hashes(0, at, length), words.hashes(1, at, length)
                rank = batch.column("rank_id").to_numpy()[row]
                order = np.lexsort((rank, w2, w1))
                w1, w2, rank, row, at = (x[order] for x in (w1, w2, rank, row, at))
                new = np.ones(len(w1), bool)
                new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                yield pa.RecordBatch.from_arrays(
                    [signed(w1), signed(w2), batch.column("_k").take(pa.array(row)), pa.array(rank), pa.array((at - words.first[row]).astype(np.int32)), pa.array(rank > rank[head])],
                    ["w1", "w2", "k", "rank", "pos", "later"],
                )

    return texts.mapInArrow(run, "w1 bigint, w2 bigint, k bigint, rank bigint, pos int, later boolean")


def packed(pos: str, n: str) -> F.Column:
    return F.shiftleft(F.col(pos).cast("long"), 32) + F.col(n)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(k, rank, pos, n, src_k, src_rank, src_pos): n windows from word ``pos`` on of the row (a hash of id and
    text, and the id) that smaller documents have; where a whole span repeats a path, its source and the
    place there (null for single windows at the ends of passages)."""
    if length < SEED + 8:
        raise ValueError(f"length must be at least {SEED + 8} words")
    rows = keyed(docs, id_col, text_col).withColumn("rank_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    scratch = Scratch(docs.sparkSession, "de-bruijn")
    every = scratch.keep(places(rows, length))
    # what is joined is a table of its own, so that Spark can split a seed, edge or window with very many places
    seeds = scratch.keep(every.groupBy("seed").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi").select("seed"))
    some = scratch.keep(every.join(seeds, "seed"))
    edges = scratch.keep(
        some.groupBy("e1", "e2").agg(
            F.min("seed").alias("seed"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n_places"),
            F.min("following").alias("least_next"), F.max("following").alias("most_next"), F.min(F.struct("rank", "k", "pos", "n")).alias("src"),
        )
    )
    several = scratch.keep(edges.groupBy("seed").agg(F.count("*").alias("c"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("c > 1 and lo < hi").select("seed", F.lit(True).alias("unlike")))
    known = scratch.keep(edges.select("e1", "e2", "seed", "first").join(several, "seed", "left").drop("seed").join(compacted(edges), ["e1", "e2"], "left"))
    told = scratch.keep(some.select("k", "rank", "pos", "n", "e1", "e2").join(known, ["e1", "e2"]).where("rank > first or unlike").drop("e1", "e2"))

    behind = told.where("rank > first").withColumn("away", F.col("pos") - F.col("src.pos"))
    spans = behind.groupBy("k", "rank", "src.k", "src.rank", "head", "away").agg(F.collect_set(F.struct("pos", "n")).alias("parts"), F.min("pos").alias("start"), F.max(F.col("pos") + F.col("n")).alias("end"))
    spans = spans.toDF("k", "rank", "src_k", "src_rank", "head", "away", "parts", "start", "end")
    whole = F.aggregate("parts", F.lit(0), lambda a, x: a + x["n"]) == F.col("end") - F.col("start")
    parts = F.when(whole, F.array(F.struct(F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("n")))).otherwise(F.col("parts"))
    spans = spans.select("k", "rank", F.explode(parts).alias("s"), "src_k", "src_rank", "away").select("k", "rank", "s.pos", "s.n", "src_k", "src_rank", (F.col("s.pos") - F.col("away")).alias("src_pos"))

    ends = told.where("rank = first and unlike").groupBy("k", "rank").agg(F.collect_set(packed("pos", "n")).alias("want"))
    texts = rows.join(ends.hint("shuffle_hash"), (rows._k == ends.k) & (rows.rank_id == ends["rank"])).select("_k", "rank_id", "text", "want")
    single = scratch.keep(windows(texts, length))
    firsts = scratch.keep(single.groupBy("w1", "w2").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi").select("w1", "w2", "lo"))
    hits = single.where("later").select("k", "rank", "pos").unionByName(single.where("not later").join(firsts, ["w1", "w2"]).where("rank > lo").select("k", "rank", "pos"))
    none = F.lit(None).cast("long")
    out = materialize(spans.unionByName(hits.select("k", "rank", "pos", F.lit(1).alias("n"), none.alias("src_k"), none.alias("src_rank"), none.cast("int").alias("src_pos"))), "word-spans")
    scratch.drop()
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, spans (maximal removed runs, from word ``start`` to before ``end``) and kept (what is
    left, words joined by one space, UTF-8)."""
    rows = keyed(docs, id_col, text_col).withColumn("rank_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length).groupBy("k", "rank").agg(F.collect_set(packed("pos", "n")).alias("gone"))
    joined = rows.join(spans.hint("shuffle_hash"), (rows._k == spans.k) & (rows.rank_id == spans["rank"]), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                count, kept, removed = [], [], []
                for text, gone in zip(as_bytes(batch.column("text")), batch.column("gone").to_pylist()):
                    words = text.split()
                    count.append(len(words))
                    if not gone:
                        kept.append(b" ".join(words))
                        removed.append([])
                        continue
                    found = np.sort(np.array(gone, np.int64))
                    start = found >> 32
                    reach = np.maximum.accumulate(start + (found & 0xFFFFFFFF) + length - 1)
                    new = np.concatenate(([True], start[1:] > reach[:-1]))
                    a, b = start[new].tolist(), reach[np.concatenate((new[1:], [True]))].tolist()
                    kept.append(b" ".join([w for x, y in zip([0, *b], [*a, len(words)]) for w in words[x:y]]))
                    removed.append([{"start": x, "end": y} for x, y in zip(a, b)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_words", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
