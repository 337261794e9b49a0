"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Documents longer than a sequence are cut into whole sequences; what is left over is the first piece,
so that every later piece fills a sequence. Pieces are dealt by
a hash of what they hold into groups of at most about ``group_size``; in a group, longest first,
each piece goes where the sum over gaps of (open sequences with that gap) squared becomes
smallest; of equal choices the tightest. With ``dissolve`` the emptiest sequences are then taken
apart as long as all their pieces fit into gaps of others. Only lengths and checksums are
shuffled, never tokens.

Defined results: null or empty text is the end token alone; repeated rows are packed each;
a null id is packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import pieces, unused

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Encoder:
    """Ids of texts as the tokenizers library gives them; a special token's string is its id.

    A plain byte-level BPE file whose merges are in the order of their ids is run by tiktoken's
    engine, which then gives the same ids in a third of the time; probes are compared on loading.
    Other files are run by tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = all(not t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec["model"]["type"] == "BPE" and in_order(spec["model"]) and plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer"):
            import tiktoken

            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
            special = {t["content"]: t["id"] for t in added}
            ranks = {bytes(letters[x] for x in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
            self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
            for probe in PROBES:
                if self._fast(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                    self.fast = None
                    break

    def _fast(self, text: str) -> list[int]:
        return self.fast.encode(text, allowed_special="all")

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self._fast(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


PROBES = ("It's  a Test:\n\n 12 ünïcödé <|endoftext|> \t x ", "<|endoftext|><|endoftext|> end", "\u3000\u00a0wide\r\n\u2028we'll I'VE 3½ ٣٤ नमस्ते 👩‍👩‍👧 e\u0301", " \n \n\n   tail   ")


def in_order(model: dict) -> bool:
    """Whether the n-th merge makes the n-th id, so that the order of ids is that of merges."""
    vocab, last = model["vocab"], -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocab[left + right] < last:
            return False
        last = vocab[left + right]
    return True


_encoders: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for,
    ``ids`` (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _encoders[tokenizer_path]
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                out: list[tuple] = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids.append(end_id)
                    data = np.array(ids, "<u4").tobytes()
                    first = len(ids) % size or size
                    for k, at in enumerate([0, *range(first, len(ids), size)]):
                        part = data[4 * at : 4 * (at + size if k else first)]
                        out.append((doc, k, at, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*out)) if out else [[]] * 6
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:5], names if with_ids else names[:5])

    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece (lengths from 1 to size).

    With N(g) sequences of gap g, putting s tokens into one changes the sum of squares by
    2 (N(g-s) - N(g) + 1), or by 1 - 2 N(g) if it closes; a new sequence by 2 N(size-s) + 1.
    """
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(size + 1, np.int64)  # count[0] stays 0: closed sequences don't count
    holders: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        if s == size:
            sequence[i] = made
            made += 1
            continue
        gaps = count[s:size]
        change = 2 * (count[: size - s] - gaps) + 2
        change[0] -= 1
        change[gaps == 0] = 1 << 60
        best = int(np.argmin(change)) if len(change) else 0
        if len(change) and change[best] <= 2 * count[size - s] + 1:
            gap = s + best
            which = holders[gap].pop()
            count[gap] -= 1
        else:
            gap, which = size, made
            made += 1
        sequence[i], offset[i] = which, size - gap
        if gap > s:
            count[gap - s] += 1
            holders[gap - s].append(which)
    return sequence, offset


def emptied(sequence: np.ndarray, offset: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Dissolve sequences, the emptiest first, as long as all their pieces fit into gaps of others."""
    n = int(sequence.max()) + 1 if len(sequence) else 0
    fill = np.bincount(sequence, lengths, n).astype(np.int64)
    open_ = sorted((size - int(fill[q]), q) for q in np.flatnonzero(fill < size))
    members: dict[int, list[int]] = {q: [] for _, q in open_}
    for i in np.flatnonzero(fill[sequence] < size).tolist():
        members[int(sequence[i])].append(i)
    gone = []
    while len(open_) > 1 and sum(g for g, _ in open_) >= size:
        gap, least = open_.pop()
        trial, moves = list(open_), []
        for i in sorted(members[least], key=lambda i: -lengths[i]):
            at = bisect.bisect_left(trial, (int(lengths[i]), -1))
            if at == len(trial):
                break
            g, q = trial.pop(at)
            moves.append((i, q, size - g))
            if g > lengths[i]:
                bisect.insort(trial, (g - int(lengths[i]), q))
        else:
            open_ = trial
            gone.append(least)
            for i, q, o in moves:
                sequence[i], offset[i] = q, o
                members[q].append(i)
            continue
        break
    if gone:  # numbers without holes
        sequence = sequence - np.searchsorted(np.sort(gone), sequence)
    return sequence, offset


def most_pieces(docs: DataFrame, *, text_col: str = "text", size: int = 2048) -> int:
    """A bound for the number of pieces: a token is a byte at least."""
    n, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()
    return n + (n_bytes or 0) // size


def pack(parts: DataFrame, n_parts: int, *, size: int = 2048, group_size: int = 50_000, dissolve: bool = True) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece (columns doc_id, piece, start, length, ids_crc32
    and any others). ``n_parts`` is the number of pieces, or a bound for it."""
    groups = max(1, -(-n_parts // group_size))
    name = unused(parts, "_group")
    dealt = parts.withColumn(name, F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns([name]).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        sequence, offset = sum_of_squares(lengths, size)
        if dissolve:
            sequence, offset = emptied(sequence, offset, lengths, size)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 40) + sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy(name).applyInArrow(run, schema)
