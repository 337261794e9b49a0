"""Trigram language model in Elias-Fano tries, trained and queried by Spark jobs.

Levels, each cut into shards that are files in the shared folder and mapped into memory:

* words: the sorted 64-bit hashes of the vocabulary with their counts; a word's id is its rank.
* bigrams: keys (word, next word) of all bigrams seen ``min_count`` times or more, as an
  Elias-Fano sequence; because keys are ordered by the first word, each word's successors are
  one range.
* trigrams: keys (bigram, next word), where the next word is given relative to its context:
  its rank among the successors of the bigram's second word. Only trigrams whose two bigrams
  are kept can be kept, so only those are counted.

Monotone pointers (first entry of each context) and probabilities in steps of 1/STEP decade, 16
bits each, go with every level. Probabilities are by interpolated absolute discounting: a context
gives (count - discount) / total to each kept successor and what remains to the shorter context.
At the bottom a word has (count - d) / N, and unknown words share the d V / N left over.

Counting is partial in each task (a word, bigram or trigram once a chunk), so frequent n-grams
reach their shard once a chunk. Shards are cut at equal numbers of tokens, within the successors of
a frequent context as well: an n-gram's place is its context's tokens and of those the share that
stands before its last word. Contexts that are cut have their shares of all shards added up by the
driver, at most two a shard; their entries keep the undivided part alone, and queries add the rest.
Shards grow in number with the corpus; nothing of it passes through the driver but a line for each.
A shard file is written under a name of its own and renamed, so lost or repeated tasks do no harm.

Defined results: null or empty text is the end token alone; unknown words have the unknown
probability; a model of no documents gives log10 probability 0; repeated rows count and score
each.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import as_bytes, cleaned, pieces, shared_dir, text_bytes, word_hashes
from specmine.llm.minhash import LOWER, SPACE
from specmine.llm.warc import open_fs

END = np.uint64(0x45D9F3B3335B369)  # the end token's hash
STEP = 2000  # quantised steps for each decade: 16 bits reach down to 1e-32
DISCOUNT = 0.75
CHUNK = 4 << 20
SHARD_TOKENS = 3_000_000


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, a place of each, and for each key the rank of its value."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, a place of each, and how often each occurs."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return ranked[first], order[first], np.diff(np.append(first, len(keys)))


# ---- Elias-Fano sequences


def ef_encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Increasing values below ``universe``: low bits packed, high bits in unary, and for each
    word of the high bits the number of zeros before it."""
    n = len(values)
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    bits = np.arange(n, dtype=np.uint64) * np.uint64(low)
    lower = np.zeros(int(n * low) // 64 + 2, np.uint64)
    if low:
        part = values & np.uint64((1 << low) - 1)
        at, off = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
        np.bitwise_or.at(lower, at, part << off)
        over = off + np.uint64(low) > 64
        np.bitwise_or.at(lower, at[over] + 1, part[over] >> (np.uint64(64) - off[over]))
    high = (values >> np.uint64(low)).astype(np.int64)
    size = n + (universe >> low) + 2
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[high + np.arange(n)] = 1
    upper = np.packbits(flags, bitorder="little").view(np.uint64)
    ones = flags.reshape(-1, 64).sum(axis=1)
    zeros = 64 * np.arange(len(upper) + 1, dtype=np.int64) - np.concatenate(([0], np.cumsum(ones)))
    return {"lower": lower, "upper": upper, "zeros": zeros.astype("<u4" if size < 1 << 32 else "<u8"), "low": np.array([low, n], np.int64)}


def _ends(ef: dict[str, np.ndarray], high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of values whose high part is ``high`` or less: ones before the zero of that rank. Also that zero's word and its
    place in it."""
    word = np.searchsorted(ef["zeros"], high.astype(ef["zeros"].dtype), "right") - 1
    left = (high - ef["zeros"][word].astype(np.int64)).astype(np.uint8)
    own = ef["upper"][word]
    bits, place = ~own, np.zeros(len(high), np.uint64)
    for width in (32, 16, 8, 4, 2, 1):  # the zero of rank `left` in its word, by halves
        here = np.bitwise_count(bits & np.uint64((1 << width) - 1))
        over = left >= here
        left -= here * over
        step = over * np.uint64(width)
        place += step
        bits >>= step
    return 64 * word + place.astype(np.int64) - high, own, place


def _ranges(ef: dict[str, np.ndarray], high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) of the values whose high part is ``high``: the run of ones before the zero of that rank."""
    end, own, place = _ends(ef, high)
    # the word's zeros before that place, moved to the top, and all places below the highest: what is left over is the run
    gaps = np.where(place > 0, ~own << (np.uint64(64) - np.maximum(place, np.uint64(1))), np.uint64(0))
    for width in (1, 2, 4, 8, 16, 32):
        gaps |= gaps >> np.uint64(width)
    begin = end - (64 - np.bitwise_count(gaps).astype(np.int64))
    far = np.flatnonzero(gaps == 0)  # ones from the word's start on: the run may begin in an earlier word
    if len(far):
        begin[far] = np.where(high[far] > 0, _ends(ef, np.maximum(high[far] - 1, 0))[0], 0)
    return begin, end


def ef_find(ef: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Index of each key (increasing), or -1."""
    low, n = (int(x) for x in ef["low"])
    out = np.full(len(keys), -1, np.int64)
    if not n or not len(keys):
        return out
    high = (keys >> np.uint64(low)).astype(np.int64)
    top = int(ef["zeros"][-1]) - 1
    todo = np.flatnonzero(high < top)
    if not len(todo):
        return out
    part = high[todo]  # increasing, as the keys are
    new = np.concatenate(([True], part[1:] != part[:-1]))
    back, part = np.cumsum(new) - 1, part[new]
    at, end = (x[back] for x in _ranges(ef, part))
    want = keys[todo] & np.uint64((1 << low) - 1)
    stop, live = end.copy(), np.flatnonzero(at + 1 < end)  # a single one is compared below
    while len(live):  # low parts increase within a high part: halve the range
        middle = (at[live] + stop[live]) // 2
        less = ef_low(ef, middle, low) < want[live]
        at[live] = np.where(less, middle + 1, at[live])
        stop[live] = np.where(less, stop[live], middle)
        live = live[at[live] < stop[live]]
    inside = np.flatnonzero(at < end)
    hit = inside[ef_low(ef, at[inside], low) == want[inside]]
    out[todo[hit]] = at[hit]
    return out


def ef_low(ef: dict[str, np.ndarray], at: np.ndarray, low: int) -> np.ndarray:
    if not low:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(low)
    word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    rest = np.where(off > 0, ef["lower"][word + 1] << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
    return ((ef["lower"][word] >> off) | rest) & np.uint64((1 << low) - 1)


# ---- shard files


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in 32 bits if they fit, else in 64."""
    return x.astype("<u4" if not len(x) or int(x.max()) < 1 << 32 else "<u8")


def write_shard(path: str, arrays: dict[str, np.ndarray]) -> None:
    fs, target = open_fs(path)
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    head += b" " * (-(len(head) + 8) % 16)
    draft = f"{target}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            data = a.tobytes()
            out.write(data + b"\0" * (-len(data) % 16))
    fs.move(draft, target)


def load_shard(path: str) -> dict[str, np.ndarray]:
    """The shard's arrays: mapped into memory where the folder is a local path, else read."""
    if path.startswith("file:") or "://" not in path:
        data = np.asarray(np.memmap("/" + path.removeprefix("file:").lstrip("/"), np.uint8, "r"))
    else:
        fs, target = open_fs(path)
        with fs.open_input_stream(target, compression=None) as f:
            data = np.frombuffer(f.read(), np.uint8)
    n = int(data[:8].view("<u8")[0])
    at, out = 8 + n, {}
    for name, kind, size in json.loads(bytes(data[8 : 8 + n])):
        width = np.dtype(kind).itemsize * size
        out[name] = data[at : at + width].view(kind)
        at += width + -width % 16
    return out


MAPPED, LOADED = 4000, 256 << 20  # shards mapped at a time; bytes of those that can't be mapped
_shards: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def shard(path: str) -> dict[str, np.ndarray]:
    """A shard's arrays, kept for the next call: the latest used, as many as the limits allow."""
    if path in _shards:
        _shards.move_to_end(path)
    else:
        mapped = path.startswith("file:") or "://" not in path
        held = 0 if mapped else sum(a.nbytes for x in _shards.values() for a in x.values())
        while len(_shards) >= MAPPED or held > LOADED:
            held -= sum(a.nbytes for a in _shards.popitem(last=False)[1].values())
        _shards[path] = load_shard(path)
    return _shards[path]


# ---- tokens


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, an end token behind each text's; tokens of each text."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    start, _, words = word_hashes(data, SPACE)
    cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    counts = np.diff(np.concatenate(([0], cut))) + 1
    out = np.insert(words, cut, END)
    return out, counts


def _chunks(df: DataFrame, make, schema: str) -> DataFrame:
    """``make(texts)`` gives the output columns of a chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                yield from make(as_bytes(batch.column("text")))

    return df.select("text").mapInArrow(run, schema)


COUNTED = "shard int, n int, payload binary"


def _planes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys byte plane by byte plane (the high ones shrink to little), and counts."""
    planes = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    small = np.minimum(counts, 255).astype(np.uint8)
    return planes.tobytes() + small.tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def _unplaned(n: int, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.ascontiguousarray(np.frombuffer(payload, np.uint8, 8 * n).reshape(8, n).T).view("<u8")[:, 0]
    counts = np.frombuffer(payload, np.uint8, n, 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(payload, "<u4", -1, 9 * n)
    return keys, counts


def _counted(keys: np.ndarray, shards: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys with their counts, a row for each shard (shards don't decrease)."""
    if not len(keys):
        return
    cut = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(keys)]))
    rows = [(int(shards[a]), int(b - a), _planes(keys[a:b], counts[a:b])) for a, b in zip(cut, cut[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["shard", "n", "payload"])


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unplaned(n, p) for b in batches for n, p in zip(b.column("n").to_pylist(), b.column("payload").to_pylist())]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def quantised(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities in steps of 1/STEP, from 0 down; below 1e-32 isn't told apart."""
    return np.clip(np.rint(-STEP * np.log10(np.maximum(p, 1e-300))), 0, 65535).astype("<u2")


def restored(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) / -STEP


class Cut:
    """Contexts whose successors lie in several shards: their numbers in order, what they leave to
    shorter contexts, and their first entry over all shards."""

    def __init__(self, parts: list[tuple[int, int, float, int]] = []):  # noqa: B006
        given: dict[int, float] = {}
        begin: dict[int, int] = {}
        for _, context, share, first in sorted(parts):  # by shard
            given[context] = given.get(context, 0.0) + share
            begin.setdefault(context, first)
        self.ids = np.array(sorted(given), np.int64)
        self.rest = np.log10(np.clip([1 - given[c] for c in sorted(given)], 1e-9, 1)) if given else np.zeros(0)
        self.begin = np.array([begin[c] for c in sorted(given)], np.int64)

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``contexts`` that are cut, and which they are."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.ids, contexts), len(self.ids) - 1)
        hit = np.flatnonzero(self.ids[at] == contexts)
        return hit, at[hit]


class Model:
    """Where the shards are and the few numbers that all of them share; queries by batch."""

    def __init__(self, top: str, min_count: int = 1, discount: float = DISCOUNT):
        self.top, self.min_count, self.less = top, min_count, discount
        self.tokens = self.types = self.ones = self.twos = 0
        self.word_starts: list[int] = [0]  # ids and tokens before each word shard
        self.token_starts: list[int] = [0]
        self.bigram_shards = self.trigram_shards = 0
        self.bigram_starts: list[int] = [0]  # bigrams and their occurrences before each bigram shard
        self.bigram_mass: list[int] = [0]
        self.widest = 1
        self.cut_words, self.cut_bigrams = Cut(), Cut()

    # numbers of the bottom level

    @property
    def discount(self) -> float:
        return self.ones / (self.ones + 2 * self.twos) if self.ones else 0.0

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        left = max(self.discount * self.types / self.tokens, 1 / (self.tokens + 1))
        known = np.maximum(counts - self.discount, 0) / self.tokens
        return np.where(counts > 0, known, left)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), counts and tokens before, of sorted hashes."""
        n = len(self.word_starts) - 1
        ids, counts, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        which = word_shard(hashes, n) if n else ids
        cut = np.searchsorted(which, np.arange(n + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            x, a, b = shard(f"{self.top}/words-{s}"), cut[s], cut[s + 1]
            if not len(x["hash"]):
                continue
            at = np.minimum(np.searchsorted(x["hash"], hashes[a:b]), len(x["hash"]) - 1)
            hit = x["hash"][at] == hashes[a:b]
            ids[a:b][hit] = at[hit] + self.word_starts[s]
            counts[a:b][hit] = x["count"][at[hit]]
            before[a:b][hit] = x["before"][at[hit]].astype(np.int64) + self.token_starts[s]
        return ids, counts, before

    def place(self, n_shards: int, before: np.ndarray, count: np.ndarray, share: np.ndarray | float) -> np.ndarray:
        """Shard of an n-gram: ``before`` tokens lie before its context, which has ``count``, and a
        ``share`` of those before its last word."""
        return ((before + count * share) / max(1, self.tokens) * n_shards).astype(np.int64).clip(0, max(0, n_shards - 1))

    def is_cut(self, n_shards: int, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether a context's successors may lie in several shards."""
        return self.place(n_shards, before, count, 0.0) != self.place(n_shards, before, count, 1 - 1 / max(1, self.tokens))

    def find(self, level: str, n_shards: int, keys: np.ndarray, shards: np.ndarray, *fields: str) -> list[np.ndarray]:
        """Index within its shard (-1: none) and stored log10 probability of sorted keys, and more
        fields of what was found."""
        out = [np.full(len(keys), -1, np.int64), np.zeros(len(keys)), *(np.zeros(len(keys), np.int64) for _ in fields)]
        cut = np.searchsorted(shards, np.arange(n_shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            x, a, b = shard(f"{self.top}/{level}-{s}"), cut[s], cut[s + 1]
            if "lower" not in x:
                continue
            base = np.uint64(int(x["base"][0]))
            inside = keys[a:b] >= base
            found = np.full(b - a, -1, np.int64)
            found[inside] = ef_find(x, keys[a:b][inside] - base)
            out[0][a:b] = found
            hit = found >= 0
            out[1][a:b][hit] = restored(x["probability"][found[hit]])
            for o, f in zip(out[2:], fields):
                o[a:b][hit] = x[f][found[hit]]
        return out


def word_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Coded:
    """A chunk's tokens looked up in the model's words: ids, counts and tokens before."""

    def __init__(self, model: Model, texts: list[bytes]):
        hashes, self.sizes = token_hashes(texts)
        known, _, back = distinct(hashes)
        ids, counts, before = model.words(known)
        self.ids, self.before, self.back, self.word_counts = ids[back], before[back], back, counts
        end = np.searchsorted(known, END)
        self.first = np.cumsum(self.sizes) - self.sizes

        def shifted(x: np.ndarray) -> np.ndarray:  # each text's first word follows an end token
            out = np.concatenate(([0], x[back][:-1]))
            out[self.first] = x[end]
            return out

        self.left, self.left_before, self.left_count = shifted(ids), shifted(before), shifted(counts)
        self.share = self.before / max(1, model.tokens)

    def bigrams(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key of the bigram ending at each token, its shard, and whether both words are known."""
        known = (self.ids >= 0) & (self.left >= 0)
        keys = self.left.astype(np.uint64) * np.uint64(max(1, model.types)) + self.ids.astype(np.uint64)
        return keys, model.place(model.bigram_shards, self.left_before, self.left_count, self.share), known


def _looked_up(model: Model, level: str, n_shards: int, keys: np.ndarray, shards: np.ndarray, known: np.ndarray, *fields: str) -> list[np.ndarray]:
    """``Model.find`` for keys in any order; the shards too, before the further fields."""
    out = [np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.zeros(len(keys), np.int64), *(np.zeros(len(keys), np.int64) for _ in fields)]
    if known.any() and n_shards:
        one, first, back = distinct(keys[known])
        own = shards[known][first]
        at, value, *more = model.find(level, n_shards, one, own, *fields)
        for o, x in zip(out, (at, value, own, *more)):
            o[known] = x[back]
    return out


class Pairs:
    """The bigrams that end at each token of a chunk: where they are kept, and as contexts."""

    def __init__(self, model: Model, coded: Coded):
        keys, self.shards, known = coded.bigrams(model)
        self.at, self.value, self.where, count, before = _looked_up(model, "bigrams", model.bigram_shards, keys, self.shards, known, "count", "before")
        starts, mass = np.array(model.bigram_starts, np.int64), np.array(model.bigram_mass, np.int64)
        self.whole = np.where(self.at >= 0, starts[self.where] + self.at, -1)
        # as contexts of the next token; a text's first word has one word of context
        self.context = np.concatenate(([-1], self.whole[:-1]))
        self.context[coded.first] = -1
        self.context_count = np.concatenate(([0], count[:-1]))
        self.context_before = np.concatenate(([0], (mass[self.where] + before)[:-1]))

    def trigrams(self, model: Model, coded: Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key of the trigram ending at each token: the bigram before it, and the rank of the token
        among the successors of the word before it. Known if both bigrams are kept."""
        known = (self.whole >= 0) & (self.context >= 0)
        keys = np.zeros(len(known), np.uint64)
        some = np.flatnonzero(known)
        if len(some):
            left, where = coded.left[some], self.where[some]
            begin = np.zeros(len(some), np.int64)
            for s in np.unique(where).tolist():
                x, mine = shard(f"{model.top}/bigrams-{s}"), where == s
                begin[mine] = x["pointer"][left[mine] - int(x["first"][0])] + model.bigram_starts[s]
            hit, at = model.cut_words.find(left)
            begin[hit] = model.cut_words.begin[at]
            keys[some] = self.context[some].astype(np.uint64) * np.uint64(model.widest) + (self.whole[some] - begin).astype(np.uint64)
        return keys, model.place(model.trigram_shards, self.context_before, self.context_count, coded.share), known


def train(docs: DataFrame, *, text_col: str = "text", min_count: int = 1, discount: float = DISCOUNT) -> Model:
    """Count and write the model of ``docs`` into a folder of its own in the shared folder; bigrams
    and trigrams seen less than ``min_count`` times are left out (1: none is)."""
    spark = docs.sparkSession
    model = Model(f"{shared_dir(spark)}/specmine-lm-{uuid.uuid4().hex}", min_count, discount)
    fs, top = open_fs(model.top)
    fs.create_dir(top, recursive=True)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    n = max(1, -(-text_bytes(rows) // (6 * SHARD_TOKENS)))
    folder = model.top

    def count_words(texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, _, counts = counted(token_hashes(texts)[0])
        yield from _counted(keys, word_shard(keys, n), counts)

    def write_words(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(batches)
        before = np.cumsum(counts) - counts
        write_shard(f"{folder}/words-{key[0].as_py()}", {"hash": keys, "count": counts.astype("<u8"), "before": before.astype("<u8")})
        facts = (key[0].as_py(), len(keys), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in facts], ["shard", "types", "tokens", "ones", "twos"])

    with cleaned(spark):
        facts = {r.shard: r for r in _chunks(rows, count_words, COUNTED).groupBy("shard").applyInArrow(write_words, "shard bigint, types bigint, tokens bigint, ones bigint, twos bigint").collect()}
    for s in range(n):
        if s not in facts:
            write_shard(f"{folder}/words-{s}", {k: np.zeros(0, "<u8") for k in ("hash", "count", "before")})
        r = facts.get(s)
        model.word_starts.append(model.word_starts[-1] + (r.types if r else 0))
        model.token_starts.append(model.token_starts[-1] + (r.tokens if r else 0))
        if r:
            model.ones, model.twos = model.ones + r.ones, model.twos + r.twos
    model.types, model.tokens = model.word_starts[-1], model.token_starts[-1]
    if model.types >= 1 << 32:
        raise OverflowError("pairs of words don't fit into 64-bit keys")
    model.bigram_shards = max(1, -(-model.tokens // SHARD_TOKENS))

    def count_bigrams(texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, shards, known = Coded(model, texts).bigrams(model)
        keys, first, counts = counted(keys[known])
        yield from _counted(keys, shards[known][first], counts)

    def write_bigrams(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = key[0].as_py()
        keys, counts = _summed(batches)
        left = (keys // np.uint64(model.types)).astype(np.int64)
        first, last = int(left[0]), int(left[-1])
        lefts = np.arange(first, last + 1)
        # every token but the last of a text precedes one, and an end token the next text's first
        total, before_left = _word_counts(model, lefts), _word_tokens_before(model, lefts)
        kept = counts >= model.min_count
        keys, counts, left = keys[kept], counts[kept], left[kept]
        given = (counts - model.less) / total[left - first]
        sums = np.bincount(left - first, given, last - first + 1)
        several = model.is_cut(model.bigram_shards, before_left, total)
        rest = np.clip(1 - sums, 1e-9, 1)
        right = (keys % np.uint64(model.types)).astype(np.int64)
        p = given + np.where(several, 0, rest)[left - first] * model.word_probability(_word_counts(model, right))
        pointer = np.concatenate(([0], np.cumsum(np.bincount(left - first, minlength=last - first + 1))))
        base = first * model.types
        before = np.cumsum(counts) - counts
        write_shard(f"{folder}/bigrams-{number}", {"base": np.array([base], "<u8"), "first": np.array([first], "<i8"), **ef_encode(keys - np.uint64(base), (last - first + 1) * model.types), "pointer": pointer.astype("<u4"), "rest": quantised(rest), "probability": quantised(p), "count": narrow(counts), "before": narrow(before)})
        some = np.flatnonzero(several)
        facts = ([number], [len(keys)], [int(counts.sum())], [int(np.diff(pointer).max())], [lefts[some].tolist()], [sums[some].tolist()], [pointer[some].tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(facts, (*[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())))], ["shard", "kept", "mass", "widest", "cut", "given", "at"])

    ddl = "shard bigint, kept bigint, mass bigint, widest bigint, cut array<bigint>, given array<double>, at array<bigint>"
    with cleaned(spark):
        facts = {r.shard: r for r in _chunks(rows, count_bigrams, COUNTED).groupBy("shard").applyInArrow(write_bigrams, ddl).collect()}
    parts, widths = [], {}
    for s in range(model.bigram_shards):
        if s not in facts:
            write_shard(f"{folder}/bigrams-{s}", {"base": np.zeros(1, "<u8")})
        else:
            parts += [(s, c, g, model.bigram_starts[-1] + a) for c, g, a in zip(facts[s].cut, facts[s].given, facts[s]["at"])]
            for i, (c, a) in enumerate(zip(facts[s].cut, facts[s]["at"])):
                widths[c] = widths.get(c, 0) + facts[s].kept  # an upper bound for successors in several shards
        model.bigram_starts.append(model.bigram_starts[-1] + (facts[s].kept if s in facts else 0))
        model.bigram_mass.append(model.bigram_mass[-1] + (facts[s].mass if s in facts else 0))
    model.cut_words = Cut(parts)
    model.widest = max([1, *(r.widest for r in facts.values()), *widths.values()])
    if model.bigram_starts[-1] * model.widest >= 1 << 64:
        raise OverflowError("bigrams and ranks don't fit into 64-bit keys")
    model.trigram_shards = max(1, -(-model.bigram_mass[-1] // SHARD_TOKENS))

    def count_trigrams(texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        coded = Coded(model, texts)
        keys, shards, known = Pairs(model, coded).trigrams(model, coded)
        keys, first, counts = counted(keys[known])
        yield from _counted(keys, shards[known][first], counts)

    def write_trigrams(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(batches)
        wide = np.uint64(model.widest)
        left = (keys // wide).astype(np.int64)
        first, last = int(left[0]), int(left[-1])
        kept = counts >= model.min_count
        keys, counts, left = keys[kept], counts[kept], left[kept]
        contexts = np.arange(first, last + 1)
        total = _bigram_field(model, contexts, "count").astype(np.int64)
        given = np.maximum(counts - model.less, 0) / np.maximum(total[left - first], counts)
        sums = np.bincount(left - first, given, last - first + 1)
        rest = np.clip(1 - sums, 1e-9, 1)
        edges = np.unique([0, last - first])  # only these can go on in another shard
        before = _bigram_field(model, contexts[edges], "before").astype(np.int64) + np.array(model.bigram_mass, np.int64)[np.searchsorted(model.bigram_starts, contexts[edges], "right") - 1]
        some = edges[model.is_cut(model.trigram_shards, before, total[edges])]
        own = rest.copy()
        own[some] = 0
        # the shorter context's probability: the bigram (second word, third word)
        index = _begin(model, _bigram_words(model, left)[1]) + (keys % wide).astype(np.int64)
        shorter = _bigram_probability(model, index)
        base = first * model.widest
        write_shard(f"{folder}/trigrams-{key[0].as_py()}", {"base": np.array([base], "<u8"), "first": np.array([first], "<i8"), **ef_encode(keys - np.uint64(base), (last - first + 1) * model.widest), "rest": quantised(rest), "probability": quantised(given + own[left - first] * shorter)})
        facts = ([key[0].as_py()], [len(keys)], [contexts[some].tolist()], [sums[some].tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(facts, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))], ["shard", "kept", "cut", "given"])

    ddl = "shard bigint, kept bigint, cut array<bigint>, given array<double>"
    with cleaned(spark):
        facts = {r.shard: r for r in _chunks(rows, count_trigrams, COUNTED).groupBy("shard").applyInArrow(write_trigrams, ddl).collect()}
    model.cut_bigrams = Cut([(s, c, g, 0) for s, r in facts.items() for c, g in zip(r.cut, r.given)])
    for s in range(model.trigram_shards):
        if s not in facts:
            write_shard(f"{folder}/trigrams-{s}", {"base": np.zeros(1, "<u8")})
    return model


def _word_counts(model: Model, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.int64)
    which = np.searchsorted(model.word_starts, ids, "right") - 1
    for s in np.unique(which).tolist():
        mine = which == s
        out[mine] = shard(f"{model.top}/words-{s}")["count"][ids[mine] - model.word_starts[s]]
    return out


def _word_tokens_before(model: Model, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.int64)
    which = np.searchsorted(model.word_starts, ids, "right") - 1
    for s in np.unique(which).tolist():
        mine = which == s
        out[mine] = shard(f"{model.top}/words-{s}")["before"][ids[mine] - model.word_starts[s]].astype(np.int64) + model.token_starts[s]
    return out


def _bigram_field(model: Model, index: np.ndarray, field: str) -> np.ndarray:
    """A stored field of bigrams given by their number over all shards."""
    which = np.searchsorted(model.bigram_starts, index, "right") - 1
    out: np.ndarray | None = None
    for s in np.unique(which).tolist():
        mine = which == s
        got = shard(f"{model.top}/bigrams-{s}")[field][index[mine] - model.bigram_starts[s]]
        out = np.zeros(len(index), got.dtype) if out is None else out
        out[mine] = got
    return np.zeros(0) if out is None else out


def _bigram_words(model: Model, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second word of bigrams given by their number over all shards."""
    first, second = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
    which = np.searchsorted(model.bigram_starts, index, "right") - 1
    for s in np.unique(which).tolist():
        mine, x = which == s, shard(f"{model.top}/bigrams-{s}")
        at = index[mine] - model.bigram_starts[s]
        own = np.searchsorted(x["pointer"], at.astype(x["pointer"].dtype), "right") - 1
        low, n = (int(v) for v in x["low"])
        # high parts: the place of the one of rank `at` in the unary part, less its rank
        flags = np.unpackbits(np.ascontiguousarray(x["upper"]).view(np.uint8), bitorder="little")
        high = np.flatnonzero(flags)[at] - at
        key = (high.astype(np.uint64) << np.uint64(low)) | ef_low(x, at, low)
        first[mine] = own + int(x["first"][0])
        second[mine] = (key - own.astype(np.uint64) * np.uint64(model.types)).astype(np.int64)
    return first, second


def _begin(model: Model, words: np.ndarray) -> np.ndarray:
    """First bigram of each word, over all shards."""
    own = model.place(model.bigram_shards, _word_tokens_before(model, words), np.zeros(1), 0.0)
    begin = np.zeros(len(words), np.int64)
    for s in np.unique(own).tolist():
        mine, x = own == s, shard(f"{model.top}/bigrams-{s}")
        if "pointer" in x:
            begin[mine] = x["pointer"][np.clip(words[mine] - int(x["first"][0]), 0, len(x["pointer"]) - 1)]
        begin[mine] += model.bigram_starts[s]
    hit, at = model.cut_words.find(words)
    begin[hit] = model.cut_words.begin[at]
    return begin


def _bigram_probability(model: Model, index: np.ndarray) -> np.ndarray:
    p = 10 ** restored(_bigram_field(model, index, "probability"))
    if len(model.cut_words.ids):
        first, second = _bigram_words(model, index)
        hit, at = model.cut_words.find(first)
        p[hit] += 10 ** model.cut_words.rest[at] * model.word_probability(_word_counts(model, second[hit]))
    return p


def _left_over(model: Model, level: str, contexts: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """log10 of what contexts leave to shorter ones (0 where nothing is kept of them)."""
    rest = np.zeros(len(contexts))
    for s in np.unique(shards).tolist():
        x, mine = shard(f"{model.top}/{level}-{s}"), shards == s
        if "rest" in x:
            place = contexts[mine] - int(x["first"][0])
            inside = (place >= 0) & (place < len(x["rest"]))
            rest[np.flatnonzero(mine)[inside]] = restored(x["rest"][place[inside]])
    return rest


def _backed_off(out: np.ndarray, context: np.ndarray, at: np.ndarray, value: np.ndarray, rest: np.ndarray, cut: Cut) -> np.ndarray:
    """log10 probabilities of one level more: what is stored, or what the context leaves times the
    shorter context's; both added up where a context is cut."""
    hit, which = cut.find(context)
    rest[hit] = cut.rest[which]
    longer = np.where(at >= 0, value, out + rest)
    both = hit[at[hit] >= 0]
    longer[both] = np.log10(10 ** value[both] + 10 ** (rest[both] + out[both]))
    return longer


def log_probabilities(model: Model, texts: list[bytes]) -> tuple[Coded, np.ndarray]:
    """log10 probability of every token of a chunk."""
    coded = Coded(model, texts)
    out = np.log10(model.word_probability(coded.word_counts))[coded.back]
    if not model.tokens:
        return coded, out
    pairs = Pairs(model, coded)
    rest, some = np.zeros(len(out)), np.flatnonzero((coded.left >= 0) & (pairs.at < 0))
    rest[some] = _left_over(model, "bigrams", coded.left[some], pairs.shards[some])
    out = _backed_off(out, coded.left, pairs.at, pairs.value, rest, model.cut_words)
    keys, shards, known = pairs.trigrams(model, coded)
    at, value, _ = _looked_up(model, "trigrams", model.trigram_shards, keys, shards, known)
    rest, some = np.zeros(len(out)), np.flatnonzero((pairs.context >= 0) & (at < 0))
    rest[some] = _left_over(model, "trigrams", pairs.context[some], shards[some])
    return coded, _backed_off(out, pairs.context, at, value, rest, model.cut_bigrams)


SCORES = [("n_tokens", "bigint", pa.int64()), ("n_known", "bigint", pa.int64()), ("train_tokens", "bigint", pa.int64()), ("base_score", "double", pa.float64()), ("score", "double", pa.float64())]


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with tokens, known tokens, the training tokens, the score by
    word counts alone (add 0.1) and the model's, all log10, added."""
    added = {n for n, _, _ in SCORES}
    rest = [c for c in docs.columns if c != text_col and c not in added]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest], *[F.lit(None).cast(t).alias(n) for n, t, _ in SCORES]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col, CHUNK // 4):  # arrays that stay in cache
                coded, logs = log_probabilities(model, as_bytes(batch.column(text_col)))
                base = np.log10((coded.word_counts + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[coded.back]
                by_doc = lambda x: np.add.reduceat(x, coded.first)
                columns = (coded.sizes, by_doc((coded.ids >= 0).astype(np.int64)), np.full(len(coded.sizes), model.tokens), by_doc(base), by_doc(logs))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(x, t) for x, (_, _, t) in zip(columns, SCORES))], [*rest, *(n for n, _, _ in SCORES)])

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias(text_col)).mapInArrow(run, schema)
