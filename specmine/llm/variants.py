"""Spelling variants of words by pivotal grams.

Two words are near if one insertion, deletion or replacement of a code point makes one of the other.
Bigrams are ordered from rare to frequent over all words; a word's prefix are its three rarest bigrams
(and others like the third). One edit touches one of two disjoint bigrams at most, so:

1. Of each word's prefix, dynamic programming over the positions chooses the two disjoint bigrams, the
   pivots, that are rarest together.
2. Of two near words, take the one whose prefix ends with the rarer bigram: the edit lies behind its first pivot or
   ahead of its second. So the other word has that pivot in its prefix, at the same place from the
   start or from the end (the position limit), with the same code points on the side without the edit.
   The side with the edit is cut in half, at a place that the other word's length gives: one of the halves is the
   same as well. Pivots are indexed with the code points that stay, for each length that the other word can have,
   and prefixes look there: a few rows a word, whatever the number of words, and no list of all words with a bigram.
3. What meets is verified by edit distance, inside the join.

The table of bigram frequencies has 65,536 counters, whatever the alphabet: bigrams that share one count as
alike in the order, and are told apart in the index, which holds the code points themselves.

Defined results: words shorter than four code points, null words and empty ones aren't accepted as near
anything; an empty table gives an empty one; repeated words must be summed up by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import Scratch, materialize

COUNTERS = 1 << 16
FAR = np.int64(1 << 60)


def code_points(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words of one length, and their code points as a matrix, some at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    start = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes >= 4]).tolist():
        of_size = np.flatnonzero(sizes == size)
        step = max(1, (1 << 20) // size)
        for a in range(0, len(of_size), step):
            some = of_size[a : a + step]
            yield some, flat[start[some][:, None] + np.arange(size)]


def grams(matrix: np.ndarray) -> np.ndarray:
    """The counter of each bigram."""
    return (matrix[:, :-1] * 40_503 + matrix[:, 1:]) % COUNTERS


def frequencies(words: DataFrame) -> np.ndarray:
    """How often each counter's bigrams stand in the words: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, matrix in code_points(batch.column("word").to_pylist()):
                count += np.bincount(grams(matrix).ravel(), minlength=COUNTERS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["gram", "n"])

    counted = words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for gram, n in counted.collect():
        out[gram] = n
    return out


def two_rarest(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In each row the places of two entries, not next to each other, of the least sum: the best single
    entry up to each place is carried along, and each place is tried as the second."""
    n = len(weight)
    single, single_at = weight[:, 0].copy(), np.zeros(n, np.int64)
    best, first, second = np.full(n, 4 * FAR), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(2, weight.shape[1]):
        total = single + weight[:, j]
        better = total < best
        best, first, second = np.where(better, total, best), np.where(better, single_at, first), np.where(better, j, second)
        better = weight[:, j - 1] < single
        single, single_at = np.where(better, weight[:, j - 1], single), np.where(better, j - 1, single_at)
    return first, second


def gram_prefixes(words: DataFrame, count: np.ndarray) -> DataFrame:
    """word, n, ``last`` (order of the prefix's last bigram), ``prefix`` (places of its bigrams) and the pivots' places."""
    order = np.argsort(count, kind="stable")
    rank = np.empty(COUNTERS, np.int64)
    rank[order] = np.arange(COUNTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, matrix in code_points(batch.column("word").to_pylist()):
                gram = grams(matrix)
                at = rank[gram]
                last = np.partition(at, 2, axis=1)[:, 2]
                inside = at <= last[:, None]
                first, second = two_rarest(np.where(inside, count[gram], FAR))
                row, place = np.nonzero(inside)
                ends = np.concatenate(([0], np.cumsum(inside.sum(axis=1))))
                prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(take), batch.column("n").take(take), pa.array(last.astype(np.int32)), prefix, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))],
                    ["word", "n", "last", "prefix", "first", "second"],
                )

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, last int, prefix array<int>, first int, second int")


def near_pairs(prefixes: DataFrame) -> DataFrame:
    """(a, na, b, nb): every ordered pair of near words with their counts, once."""
    word, size = F.col("word"), F.length("word")
    part = lambda at, n: F.substring(word, at + 1, n)
    half = lambda n: F.shiftright(n, 1)
    key = lambda *parts: F.xxhash64(*[F.lit(x) if isinstance(x, int) else x for x in parts])

    def looked_up(at: F.Column) -> F.Column:
        """Keys of a word as the other one, for a bigram of its prefix: behind it and ahead of it, one half kept each."""
        h, g = half(size - at - 2), half(at)
        behind = [key(1, size, at, part(F.lit(0), at + 2 + h)), key(2, size, at, part(F.lit(0), at + 2), part(at + 2 + h, size))]
        ahead = [key(3, size, size - at, part(g, size)), key(4, size, size - at, part(F.lit(0), g), part(at, size))]
        return F.array(*behind, *ahead)

    def indexed() -> list[F.Column]:
        """The same of the pivots, for each length that the other word can have (null where it can't be)."""
        out = []
        for more in (-1, 0, 1):
            other, at = size + more, F.col("first")
            rest = other - at - 2
            h = half(rest)
            kept = rest - h
            out.append(F.when((rest >= 0) & (at + 2 + h <= size), key(1, other, at, part(F.lit(0), at + 2 + h))))
            out.append(F.when((rest >= 0) & (kept <= size - at - 2), key(2, other, at, part(F.lit(0), at + 2), part(size - kept, kept))))
            at = F.col("second")
            g = half(at + more)
            out.append(F.when(other - g <= size, key(3, other, size - at, part(size - other + g, size))))
            out.append(key(4, other, size - at, part(F.lit(0), g), part(at, size)))
        return out

    pivots = prefixes.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"), F.explode(F.array_compact(F.array(*indexed()))).alias("key_a"))
    others = prefixes.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"), F.explode(F.flatten(F.transform("prefix", looked_up))).alias("key_b"))
    found = pivots.join(others, (F.col("key_a") == F.col("key_b")) & (F.col("la") <= F.col("lb")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))).distinct()


def group_variants(words: DataFrame, *, least_ratio: int = 10) -> DataFrame:
    """word, form (the most frequent near word, of ties the least, if it is ``least_ratio`` times as frequent), root (the
    end of the chain of forms), n, n_near, form_n. ``words``: word and n, each word once."""
    spark = words.sparkSession
    scratch = Scratch(spark, "variants")
    words = scratch.keep(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word is not null"))
    pairs = scratch.keep(near_pairs(gram_prefixes(words, frequencies(words))))
    best = pairs.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w"))).alias("top"), F.max("na").alias("na"))
    known = scratch.keep(best.select("word", "n_near", F.when(-F.col("top.m") >= least_ratio * F.col("na"), F.col("top.w")).alias("form"), (-F.col("top.m")).alias("form_n")))
    roots = scratch.keep(known.where("form is not null").select("word", F.col("form").alias("root")))
    # a form is least_ratio times as frequent as its word, so chains are short; each round doubles what is followed
    most = words.agg(F.max("n")).first()[0] or 1
    longest = math.ceil(math.log(most, least_ratio)) + 1 if least_ratio > 1 else 64
    for _ in range(math.ceil(math.log2(longest + 1))):
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = scratch.keep(roots.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    out = words.join(known, "word", "left").join(roots, "word", "left")
    out = out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))
    out = materialize(out, "variants")
    scratch.drop()
    return out
