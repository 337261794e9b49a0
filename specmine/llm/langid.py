"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of labelled text. A text is parsed
against each automaton into longest matches; the language that needs the fewest phrases per
symbol wins. Before parsing, letters are lower-cased and every run of other characters
becomes one space, so digits, punctuation and markup say nothing.

The sample is the only bounded thing: at most ``docs_per_lang`` documents of a language,
picked by a hash of their ids, of each at most its first 0.4 * ``bytes_per_lang`` characters, and
at most ``bytes_per_lang`` bytes of their normalised text. Predictions are by whole texts, parsed
without cuts: stretches of ``STRETCH`` bytes run side by side from a fresh start, then each is run
again from where the one before it ended, until it falls in with its first run.

Defined results: null text or text without a letter is ``und`` with score 0; so is every text
if nothing was learned. Ties go to the language that sorts first. Repeated rows are predicted
alike. Rows with a null id are never learned from where the split needs an id.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import pieces

UNKNOWN = "und"
STRETCH = 1024
FLAG = 1 << 30
_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def sample_by_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, docs_per_lang: int = 60, bytes_per_lang: int = 40_000) -> list[tuple[str, bytes]]:
    """Labelled text of each language, of bounded size. ``learn`` says which rows may be used."""
    rows = docs.where((F.lit(True) if learn is None else learn) & F.col(f"`{lang_col}`").isNotNull() & (F.length(F.col(f"`{text_col}`")) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return []
    # 63 bits of a hash of id and text; repeated rows share theirs and are taken once
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), 1)
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(2**63 - 1, 2**63 * 4 * docs_per_lang // n))])
    # an expected four times what is wanted, however many rows there are: that is what the exact pick below gathers
    few = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("i"), place.alias("p")).where(F.col("p") <= below[F.col("lang")]).dropDuplicates(["lang", "p"])
    picked: dict[str, list[str]] = {}
    for r in few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("p", "i", F.substring("text", 1, 4 * bytes_per_lang // 10).alias("text")))), 1, docs_per_lang).alias("rows")).collect():
        picked[r.lang] = [x.text for x in r.rows]
    out = []
    for lang in sorted(picked):
        each = max(200, bytes_per_lang // max(1, len(picked[lang])))
        parts, size = [], 0
        for spread in (each, bytes_per_lang):  # an even share of each first, then more of the same while there is room
            for text in picked[lang]:
                if size < bytes_per_lang:
                    parts.append(normalise(text)[: min(spread, bytes_per_lang - size)])
                    size += len(parts[-1])
            if size >= bytes_per_lang // 2:
                break
        out.append((lang, b"\n".join(parts)))
    return out


def automaton_table(text: bytes, symbol: np.ndarray, width: int) -> np.ndarray:
    """Suffix automaton of ``text`` as one table: entry [state * width + symbol] is the next
    state's offset; where a phrase starts, it is the offset after starting anew, plus FLAG."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbol[np.frombuffer(text, np.uint8)].tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] != length[p] + 1:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
                q = clone
            link[cur] = q
        last = cur
    table = np.empty((len(nxt), width), np.int32)
    fresh = np.full(width, FLAG, np.int32)
    for c, v in nxt[0].items():
        fresh[c] = v * width | FLAG
    table[:] = fresh
    for v, row in enumerate(nxt):
        if v and row:  # what follows the root starts a phrase
            table[v, list(row)] = np.fromiter(row.values(), np.int32, len(row)) * width
    return table.ravel()


class CrossParser:
    """Counts phrases of texts against each language's automaton."""

    def __init__(self, sample: list[tuple[str, bytes]]):
        self.langs = [k for k, _ in sample]
        seen = sorted(set(b"".join(t for _, t in sample)) - {0x0A})
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.symbol[0x0A] = len(seen)
        self.tables = [automaton_table(t, self.symbol, len(seen) + 1) for _, t in sample]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per symbol, a row for each text and a column for each language."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        lanes = -(-sizes // STRETCH)
        flat = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.cumsum(sizes) - sizes
        within = (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRETCH
        start, size = first[owner] + within, np.minimum(STRETCH, sizes[owner] - within)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.full(len(order), -1)  # the stretch after each, of the same text
        follows[place[np.flatnonzero(within > 0) - 1]] = place[within > 0]
        owner, start, size = owner[order], start[order], size[order]
        steps = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right") if steps else []
        out = np.zeros((len(texts), len(self.langs)))
        for j, table in enumerate(self.tables):
            state = np.zeros(len(size), np.int32)
            count = np.zeros(len(size), np.int64)  # phrases started
            run = np.empty((steps, len(size)), np.int32)
            for i in range(steps):
                n = alive[i]
                x = table[state[:n] + flat[start[:n] + i]]
                run[i, :n] = x
                count[:n] += x >> 30
                state[:n] = x & (FLAG - 1)
            lane = follows[follows >= 0]
            entry = state[follows >= 0]
            while len(lane):
                moved = self._fall_in(table, flat, start, size, run, count, lane, entry)
                ends = run[size[moved] - 1, moved] & (FLAG - 1)
                on = follows[moved] >= 0
                lane, entry = follows[moved][on], ends[on]
            np.add.at(out[:, j], owner, count)
        return out / np.maximum(sizes, 1)[:, None]

    @staticmethod
    def _fall_in(table: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, run: np.ndarray, count: np.ndarray, lane: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Run stretches again from other states, up to where they fall in with their last run, which
        is mended in place. Returns the stretches that never did: their ends have changed."""
        moved, i = [lane[:0]], 0
        while len(lane):
            x = table[entry + flat[start[lane] + i]]
            old = run[i, lane]
            run[i, lane] = x
            count[lane] += (x >> 30) - (old >> 30)
            i += 1
            apart = (x ^ old) & (FLAG - 1) != 0
            over = size[lane] == i
            moved.append(lane[apart & over])
            lane, entry = lane[apart & ~over], x[apart & ~over] & (FLAG - 1)
        return np.concatenate(moved)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        there = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if there:
            rates = self.phrases([normalise(texts[i]) for i in there])
            best = np.argmin(rates, axis=1)
            other = np.sort(rates, axis=1)[:, 1] if len(self.langs) > 1 else np.ones(len(there))
            low = rates[np.arange(len(there)), best]
            score = 1 - low / np.maximum(other, 1e-12)
            out_scores = np.clip(np.where(np.isfinite(score), score, 0), 0, 1)
            for i, b, s in zip(there, best, out_scores):
                out[i] = (self.langs[b], float(s))
        return out


_parsers: dict[str, CrossParser] = {}


def identify(docs: DataFrame, sample: list[tuple[str, bytes]], *, text_col: str = "text", out_cols: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every row of ``docs`` with the predicted language and a score from 0 to 1 added.

    The score is how many fewer phrases the winner needs than the next language. Columns of the
    added names that ``docs`` already has are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sample)  # bounded by bytes_per_lang
    clean = docs.drop(*out_cols)
    names = clean.columns
    schema = clean.withColumns({out_cols[0]: F.lit("").cast("string"), out_cols[1]: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch], key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(sent.value)
        try:
            for whole in batches:
                for batch in pieces(whole, text_col):
                    found = _parsers[key].predict(batch.column(text_col).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*names, *out_cols])
        finally:
            _parsers.clear()  # some 150 MB, which the worker's later tasks of other steps have no use for

    return clean.mapInArrow(run, schema)
