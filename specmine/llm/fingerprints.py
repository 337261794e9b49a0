"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the smallest hash of its inner s-mers lies at its
first or last place. That depends on the k-mer alone, so an edit moves only the anchors that
touch it. A fingerprint holds every anchor of a text with its offset, in text order; about
2 in k - s + 1 places are anchors, so ``k`` sets the density. Two fingerprints are compared by
position: the n-th occurrence of an anchor in one meets the n-th in the other, and the longest
run of such pairs in the same order, as a share of all anchors of both, is their likeness.

Defined results: null or empty text has the empty fingerprint; a text without a syncmer is
its own anchor; equal fingerprints have likeness 1 (two empty ones too), an empty and
another one 0. Repeated rows get equal fingerprints; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import LAST_ID, kmer_hashes, mix, pieces, sliding_min

K, S = 32, 8
Anchors = tuple[np.ndarray, np.ndarray]  # offsets in bytes, 32-bit hashes


def closed_syncmers(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of some bytes."""
    if len(data) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner, outer = kmer_hashes(data, s, k)
    inner = mix(inner)
    least = sliding_min(inner, k - s + 1)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    return at, mix(outer[at])


def anchors_of(text: bytes, k: int = K, s: int = S) -> Anchors:
    """Offsets and hashes of all anchors of a text, in text order."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    data = np.frombuffer(text, np.uint8)
    at, value = closed_syncmers(data, k, s)
    if not len(at):
        at, value = np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), "<u8")
    return at, (value >> np.uint64(32)).astype(np.uint32)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """A key for each anchor: its hash, and how often it came before."""
    key = hashes.astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    again = np.concatenate(([False], ranked[1:] == ranked[:-1]))
    if again.any():
        at = np.arange(len(ranked))
        key[order] |= (at - np.maximum.accumulate(np.where(again, 0, at))).astype(np.uint64) << np.uint64(32)
    return key


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Anchors of both (hashes in text order) that pair up in a common order, as a share of all."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    _, left, right = np.intersect1d(occurrences(a), occurrences(b), assume_unique=True, return_indices=True)
    place = right[np.argsort(left)]
    n = len(place)
    if n > 1 and (np.diff(place) < 0).any():  # the longest increasing run
        chain: list[int] = []
        for x in place.tolist():
            i = bisect.bisect_left(chain, x)
            chain[i : i + 1] = [x]
        n = len(chain)
    return n / (len(a) + len(b) - n)


def as_text(hashes: np.ndarray) -> str:
    """Eight hex digits for each anchor."""
    return hashes.astype(">u4").tobytes().hex()


def cut_points(rows: DataFrame, n_buckets: int, each: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Ids and text hashes between ``n_buckets`` ranges of about equal size, from a sample of about
    ``each`` rows a range. Any cuts give the same results; even ones give even tasks."""
    if n_buckets < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = (1 << 32) - 1
    share = min(1.0, each * n_buckets / max(1, rows.count()))
    few = rows.where(F.pmod(F.xxhash64("rank_id", "text_hash", F.lit("cut")), F.lit(of)) < int(share * of)).select("rank_id", "text_hash").toArrow()
    rank, hashed = few["rank_id"].to_numpy(), few["text_hash"].to_numpy()
    order = np.lexsort((hashed, rank))[np.linspace(0, max(0, len(rank) - 1), n_buckets + 1).astype(np.int64)[1:-1]] if len(rank) else np.zeros(0, np.int64)
    return rank[order], hashed[order]


def place_among(cuts: tuple[np.ndarray, np.ndarray], rank: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """How many cuts lie below each row; rows with a cut's id are told apart by their hashes."""
    low, high = np.searchsorted(cuts[0], rank, "left"), np.searchsorted(cuts[0], rank, "right")
    out = low.copy()
    for i in np.unique(low[high > low]).tolist():
        mine = np.flatnonzero((low == i) & (high > low))
        out[mine] = i + np.searchsorted(cuts[1][i : high[mine[0]]], hashed[mine], "left")
    return out.astype(np.int32)


def next_texts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (bucket, own, rank_id, text_hash, doc_id, text) such that, in descending order of
    ``rank_id`` and ``text_hash`` within a bucket, each row with ``own`` is followed by its successor.

    Buckets are ranges of ids; the first row of a bucket is sent to the bucket before it as
    well, and the very first row to the last one. Texts are shuffled once; what comes to the
    driver is one line a bucket. Rows equal in id and text stay together.
    """
    cuts = cut_points(docs, n_buckets)

    @F.pandas_udf("int")
    def bucket_of(rank, hashed):
        import pandas as pd

        return pd.Series(place_among(cuts, rank.to_numpy(), hashed.to_numpy()))

    rows = docs.withColumn("bucket", bucket_of("rank_id", "text_hash"))
    tops = rows.groupBy("bucket").agg(F.max(F.struct("rank_id", "text_hash")).alias("top")).collect()  # one row a bucket
    there = sorted((r.bucket, r.top.rank_id, r.top.text_hash) for r in tops)
    if not there:
        return rows.select("bucket", F.lit(True).alias("own"), "rank_id", "text_hash", "doc_id", "text")
    # ids fall: the top of a bucket follows the last row of the next one, the very top that of the first
    lines = [(b, r, h, there[(i + 1) % len(there)][0]) for i, (b, r, h) in enumerate(there)]
    heads = docs.sparkSession.createDataFrame(lines, "bucket int, r bigint, h bigint, before int")
    marked = rows.join(F.broadcast(heads) if len(lines) <= 1_000_000 else heads, "bucket")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))
    first = (F.col("rank_id") == F.col("r")) & (F.col("text_hash") == F.col("h"))
    to = F.when(first, F.array(own, copy)).otherwise(F.array(own))
    return marked.select(F.explode(to).alias("_to"), "rank_id", "text_hash", "doc_id", "text").select("_to.bucket", "_to.own", "rank_id", "text_hash", "doc_id", "text")


def bucket_count(n_rows: int, bucket_rows: int) -> int:
    """Buckets of ``bucket_rows`` up to 2000 of them, then larger ones of up to 50,000 rows, then
    more of those: a task reads its bucket as a stream, so none grows without end."""
    return max(1, -(-n_rows // 50_000), min(-(-n_rows // bucket_rows), 2000))


def fingerprints_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, bucket_rows: int = 8000) -> DataFrame:
    """Fingerprints of every text, of its edited text (second half replaced by the beginning of
    the next document's) and their likeness; ``anchor_offsets`` are those of the text's anchors.

    Null ids come first in the descending order; equal ids are ordered by a hash of their text.
    """
    ident, body = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(ident.alias("doc_id"), body.alias("text"), F.coalesce(ident, F.lit(LAST_ID)).alias("rank_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_hash"))
    n_buckets = bucket_count(rows.count(), bucket_rows)
    placed = next_texts(rows, n_buckets)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, anchor_offsets array<int>"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "anchor_offsets"]

    def emit(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        out: list[tuple] = []
        known: tuple = (None, None)  # the text before, and its anchors
        for doc, text, following in pairs:
            half = len(text) // 2
            edited = (text[: len(text) - half] + following[:half]).encode()
            at, mine = known[1] if known[0] is text else anchors_of(text.encode(), k, s)
            theirs, (_, changed) = anchors_of(following.encode(), k, s), anchors_of(edited, k, s)
            known = (following, theirs)
            out.append((doc, len(text), hashlib.sha256(edited).hexdigest(), as_text(mine), as_text(changed), likeness(mine, changed), likeness(mine, theirs[1]), at.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # bucket, own, doc_id, text of the row before
        for whole in batches:
            for batch in pieces(whole, "text"):
                pairs = []
                for bucket, own, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "own", "doc_id", "text"))):
                    text = text or ""
                    if last is not None and last[1] and last[0] == bucket:
                        pairs.append((last[2], last[3], text))
                    last = (bucket, own, doc, text)
                if pairs:
                    yield emit(pairs)

    order = placed.repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc("rank_id"), F.desc("text_hash"))
    return order.mapInArrow(run, schema)
