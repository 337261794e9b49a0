"""Near-duplicate documents by MinHash, banding, verification and connected components.

Each text becomes its set of five-word shingles (64-bit hashes). Documents with equal sets
form a class, whose smallest id stands for it; only representatives go on. ``BANDS * ROWS``
minima of universal hashes are taken; two representatives that agree in a whole band are
candidates. Candidates are verified on their full sets (intersection against union). Links
go to connected components by alternating large-star and small-star.

Buckets may hold any number of documents, so no bucket's pairs are spelt out. First, every
member is paired with the smallest of its bucket, and verified; the links found join most of a
bucket. Then members outside a bucket's largest component are compared with the rest of it, in
blocks of bounded size that are dealt out by bucket and block: their signatures first (pairs estimated below the threshold less four standard
errors are no links), and what is left on full sets, in the task that holds them. A link missing
from the edges thus joins documents already connected; the components are those of all links
between candidates.

A bucket with very many members outside its largest component (boilerplate that agrees in a band
but stays below the threshold) is split by its members' shingles instead (``split``), without losing
a link: those that few members share make buckets, and only members that are nearly all boilerplate
still meet the whole bucket. Rows of the others grow with their number, not with its square.

Chance that two texts at the threshold of 0.75 share no band: (1 - 0.75**4)**28, 2 in 100,000.

Defined results: null or empty text, or text of white space only, has no shingles and is
alone; fewer than five words are one shingle; repeated rows are one class; a null id stands
behind all others and is its component's id only if nothing else is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmine.llm.common import BASE, LAST_ID, Scratch, as_bytes, keyed, materialize, mix, pieces, unused, word_hashes

BANDS, ROWS, WORDS, PERCENT = 28, 4, 5, 75
BLOCK_BYTES = 16 << 20  # of sets in a block of a bucket
DEPTH = 8  # blocks of probes from which on a bucket is split
LOWER = np.frombuffer(bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)), np.uint8)
SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TIMES, PLUS = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def shingle_set(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words, or of all words if they are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = h * np.uint64(BASE) + words[i : len(words) - k + 1 + i]
    return np.unique(mix(h + np.uint64(k)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The set of each text; words are hashed for all texts at once."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    start, _, words = word_hashes(data, SPACE)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(start, ends)
    return [shingle_set(words[a:b]) for a, b in zip([0, *cut[:-1]], cut)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Upper halves of the minima of the universal hashes (a x + b) mod 2**64."""
    least = np.full(len(TIMES), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * TIMES + PLUS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def signatures(rows: DataFrame) -> DataFrame:
    """_k, rank_id, n_shingles, class (128-bit digest of the set) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                sets = shingle_sets(as_bytes(batch.column("text")))
                digest = [np.array([np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], "<u8").tobytes() if len(s) else None for s in sets]
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                columns = [batch.column("_k"), batch.column("rank_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_k", "rank_id", "n_shingles", "class", "sig"])

    return rows.select("_k", "rank_id", "text").mapInArrow(run, "_k bigint, rank_id bigint, n_shingles bigint, class binary, sig binary")


def band_keys() -> list[Column]:
    """A hash of each band's number and minima."""
    return [F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]


def banded(reps: DataFrame) -> DataFrame:
    """(bucket, rep) for every band of every representative; bucket hashes band and minima."""
    return reps.select("rep", F.explode(F.array(*band_keys())).alias("bucket"))


def sets_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(as_bytes(batch.column("text")))]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return rows.select("rep", "text").mapInArrow(run, "rep bigint, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "sb"):
                keep = []
                for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                    both = np.concatenate((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")))
                    union = len(np.unique(both))
                    keep.append(100 * (len(both) - union) >= percent * union)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have edges.

    Large-star sends every larger neighbour of a node to the least of its neighbourhood,
    small-star every smaller one and the node itself; alternating ends in stars. Neighbourhoods
    are reduced to their minima by partial aggregation and never gathered. A round that leaves
    count and checksum of the edges as they were is the last.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(star).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.keep(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members of a bucket as pairs of blocks (``bucket, blk, prb``), each row an own member of its
    block or a probe of it (``probe``).

    The component with most members of a bucket needs no comparing within itself, so only members of
    the others are probes, except those told to be ``quiet`` and with those of it told to be ``loud``.
    Each meets every block of the bucket, in blocks of probes of at most about ``block`` members and,
    where the rows carry sets (``shingles``), BLOCK_BYTES of them. A bucket of n members and s probes
    thus gives n * s / block rows and n + s at least.
    """
    size = F.octet_length("shingles") if "shingles" in members.columns else F.lit(0)
    able, sure = (lambda x: F.sum(F.when(~F.col("quiet"), x).otherwise(0))), (lambda x: F.sum(F.when(F.col("loud"), x).otherwise(0)))
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum(size).alias("b"), able(1).alias("an"), able(size).alias("ab"), sure(1).alias("sn"), sure(size).alias("sb")).groupBy("bucket")
    most = F.struct("n", "root")
    sizes = sizes.agg(F.max_by("root", most).alias("main"), F.sum("n").alias("n"), F.sum("b").alias("b"), *[(F.sum(f"a{x}") - F.max_by(F.col(f"a{x}") - F.col(f"s{x}"), most)).alias(f"p{x}") for x in "nb"])
    blocks = lambda n, b: F.greatest(F.ceil(n / block), F.when(n > 0, F.ceil(b / BLOCK_BYTES))).cast("int")
    sizes = sizes.select("bucket", "main", blocks(F.col("n"), F.col("b")).alias("_n"), blocks(F.col("pn"), F.col("pb")).alias("_p"))
    members = members.join(sizes, "bucket").where("_p > 0")
    mine = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    at = lambda blk, prb, probe: F.struct(blk.alias("blk"), prb.alias("prb"), F.lit(probe).alias("probe"))
    own = each("_p", lambda i: at(mine("_n", "own"), i, False))
    probe = each("_n", lambda i: at(i, mine("_p", "probe"), True))
    places = F.when(((F.col("root") == F.col("main")) & ~F.col("loud")) | F.col("quiet"), own).otherwise(F.concat(own, probe))
    out = members.withColumn("_at", F.explode(places)).select("*", "_at.blk", "_at.prb", "_at.probe").drop("_n", "_p", "_at")
    return out.repartition("bucket", "blk", "prb")


def shingle_lists(rows: DataFrame) -> DataFrame:
    """rep, root and its set as a list of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "shingles", 1 << 20):
                sets = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("shingles")]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("root"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "root", "shingles"])

    return rows.select("rep", "root", "shingles").mapInArrow(run, "rep bigint, root bigint, shingles array<bigint>")


def split(placed: DataFrame, reps: DataFrame, sets: DataFrame, scratch: Scratch, block: int, percent: int = PERCENT) -> DataFrame:
    """bucket, rep, root, ``quiet``, ``loud``, ``deep``, sig and band keys: the members of buckets of which more than
    one component is left. Keys of buckets that are split agree with no other member's.

    A bucket with more than DEPTH blocks of members outside its largest component goes on as cells: its
    members by their shingles, those that members of several components share. No link is lost:

    * Shingles are put in order by the number of their members. Of a pair at the threshold the first shingle
      that both have is among the first ``n - ceil(percent of n) + 1`` of either set. If at most ``block``
      members have it, both are put in its cell and compared there; a member is in no cells but those.
    * If more have it, the pair has in common only such crowded shingles, which are then at least
      ``2 * percent / (100 + percent)`` (6/7) of the smaller set. Members of which crowded shingles make up
      that share are probes of their bucket (loud); all others are quiet there.

    Shingles of the same members make one cell. A member is in as many cells as a quarter of its set has
    shingles at most, in none where that quarter is its own alone, so rows grow with the members.
    """
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket")
    sizes = scratch.keep(sizes.agg((F.sum("n") - F.max("n")).alias("others")).where("others > 0").select("bucket", (F.col("others") > DEPTH * block).alias("deep")))
    members = placed.join(sizes, "bucket")
    keys = [k.alias(f"k{i}") for i, k in enumerate(band_keys())]
    if sizes.where("deep").isEmpty():
        return members.withColumns({"quiet": F.lit(False), "loud": F.lit(False)}).join(reps.select("rep", "sig", *keys), "rep")
    deep = scratch.keep(members.where("deep").groupBy("rep", "root").agg(F.collect_set("bucket").alias("_deep")))  # at most BANDS
    flat = shingle_lists(deep.join(sets, "rep")).select("rep", "root", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("shingle"))
    whose = [F.bit_xor(F.xxhash64("rep", F.lit(i))) for i in range(2)]  # tells sets of members apart
    shared = flat.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.xxhash64(F.count("*"), *whose).alias("cell")).where("lo < hi")
    told = scratch.keep(flat.join(shared.select("shingle", "cell", "n"), "shingle").groupBy("rep", "root", "size", "cell", "n").agg(F.count("*").alias("m")))
    crowded = told.where(F.col("n") > block).groupBy("rep", "size").agg(F.sum("m").alias("m"))
    pure = scratch.keep(crowded.where(F.col("m") * (100 + percent) >= 2 * percent * F.col("size")).select("rep", F.lit(True).alias("pure")))
    members = members.join(pure, "rep", "left").select("bucket", "rep", "root", (F.col("deep") & F.col("pure").isNull()).alias("quiet"), (F.col("deep") & F.col("pure").isNotNull()).alias("loud"), "deep")
    w = Window.partitionBy("rep")
    after = F.sum("m").over(w.orderBy(F.desc("n"), F.desc("cell")))  # its own shingles and those of later ones; what nobody shares comes first
    few = told.withColumn("_after", after).where((F.col("n") <= block) & (F.col("_after") * 100 >= percent * F.col("size")))
    few = few.select(F.col("cell").alias("bucket"), "rep", "root", F.lit(False).alias("quiet"), F.lit(False).alias("loud"), F.lit(True).alias("deep"))
    own = reps.select("rep", "sig", *keys).join(deep.select("rep", "_deep"), "rep", "left")
    own = own.select("rep", "sig", *[F.when(F.array_contains("_deep", F.col(f"k{i}")), F.xxhash64("rep", F.lit(i), F.lit("deep"))).otherwise(F.col(f"k{i}")).alias(f"k{i}") for i in range(BANDS)])
    return members.unionByName(few).join(own, "rep")


def _candidates(table: pa.Table, need: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each probe the own members of another component with which its signature agrees in
    ``need`` places or more, if this bucket is split or a cell of a split one or else the first that
    the two share; of two probes, the one of the larger number sees the other."""
    rep, root, probe, quiet = (np.asarray(table[c]) for c in ("rep", "root", "probe", "quiet"))
    bucket, main, deep = (table[c][0].as_py() for c in ("bucket", "main", "deep"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(len(root), -1)
    keys = np.stack([b.to_numpy() for b in (table.column(f"k{i}") for i in range(BANDS))], 1)
    own = np.flatnonzero(~probe)
    for i in np.flatnonzero(probe).tolist():
        j = own[root[own] != root[i]]
        j = j[(root[j] == main) | quiet[j] | (rep[j] < rep[i])]
        if len(j):
            j = j[(sig[j] == sig[i]).sum(axis=1) >= need]
        if len(j) and not deep:
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(axis=1)] == bucket]
        if len(j):
            yield i, j


def involved(members: DataFrame, least_share: float, block: int) -> DataFrame:
    """(bucket, rep) of the members that have a candidate: bucket, rep, root, sig and band keys."""
    need = int(least_share * BANDS * ROWS)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        hit = np.zeros(table.num_rows, bool)
        for i, j in _candidates(table, need):
            hit[i] = hit[j] = True
        rep = np.unique(table["rep"].to_numpy()[hit])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rep), key[0].as_py()), pa.int64()), pa.array(rep, pa.int64())], ["bucket", "rep"])

    return in_blocks(members, block).groupBy("bucket", "blk", "prb").applyInArrow(run, "bucket bigint, rep bigint").distinct()


def cross_links(members: DataFrame, least_share: float, percent: int, block: int) -> DataFrame:
    """Links (a, b) between components of one bucket, verified on full sets where they stand; of
    links that join the same two components in a task one is enough."""
    need = int(least_share * BANDS * ROWS)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        rep, root = table["rep"].to_numpy(), table["root"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["shingles"]]  # views, no copies
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        links: list[tuple[int, int]] = []
        for i, j in _candidates(table, need):
            short, long = np.minimum(sizes[j], sizes[i]), np.maximum(sizes[j], sizes[i])
            j = j[100 * short >= percent * long]
            at = 0
            while at < len(j):  # some at a time, leaving out what has been joined meanwhile
                mine = find(root[i])
                some = [x for x in j[at : at + 256].tolist() if find(root[x]) != mine]
                at += 256
                if not some:
                    continue
                flat = np.concatenate([sets[x] for x in some])
                place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
                shared = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                for x in np.flatnonzero(100 * shared >= percent * (sizes[some] + sizes[i] - shared)).tolist():
                    a, b = find(root[some[x]]), find(root[i])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        links.append((int(rep[some[x]]), int(rep[i])))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return in_blocks(members, block).groupBy("bucket", "blk", "prb").applyInArrow(run, "a bigint, b bigint").distinct()


def numbered(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """``reps`` with a number ``rep`` for each class: a hash of its digest, and for classes that share
    a hash with another one (some in 10**10) a hash of another kind for all but the first."""
    number = F.xxhash64("class")
    shared = scratch.keep(reps.groupBy(number.alias("rep")).agg(F.count("*").alias("n"), F.min("class").alias("first")).where("n > 1").select("rep", "first"))
    reps = reps.withColumn("rep", number)
    if shared.isEmpty():
        return reps
    second = F.when(F.col("class") != F.col("first"), F.xxhash64("class", F.lit("second"))).otherwise(F.col("rep"))
    return scratch.keep(reps.join(shared, "rep", "left").withColumn("rep", F.coalesce(second, "rep")).drop("first"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = 1024) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept; _k and _rank, which
    together are the row's key, and _root, that of its component (null for rows without shingles,
    which are alone). An empty table gives an empty one; other columns are left behind."""
    rows = keyed(docs, id_col, text_col).withColumn("rank_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.keep(signatures(rows))
    shown = F.when(F.col("component") == LAST_ID, F.lit(None).cast("long")).otherwise(F.col("component"))
    classes = signed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("rank_id").alias("id"), F.min_by("_k", "rank_id").alias("rep_k"))
    reps = signed.select(F.col("_k").alias("rep_k"), F.col("rank_id").alias("id"), "class", "sig").join(classes, ["class", "rep_k", "id"], "left_semi").dropDuplicates(["class"])
    # one number for each class, since different texts may carry the same id
    reps = numbered(scratch.keep(reps), scratch)
    bands = banded(reps)
    heads = bands.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    crowded = scratch.keep(bands.join(heads, "bucket").select("bucket", "rep", "head"))
    wanted = crowded.select("rep").distinct().join(reps.select("rep", "rep_k", F.col("id").alias("rep_id")), "rep")
    texts = rows.join(wanted, (F.col("_k") == F.col("rep_k")) & (F.col("rank_id") == F.col("rep_id"))).select("rep", "text").dropDuplicates(["rep"])
    sets = scratch.keep(sets_of(texts))
    links = scratch.keep(verified(crowded.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), sets, percent))
    joined = components(links, scratch)
    placed = crowded.join(joined, crowded.rep == joined.node, "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    share = percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5
    members = split(placed, reps, sets, scratch, block, percent)
    close = scratch.keep(involved(members, share, block))
    more = members.join(close, ["bucket", "rep"]).join(sets, "rep")
    more = scratch.keep(cross_links(more, share, percent, block))
    roots = joined
    if not more.isEmpty():
        roots = components(joined.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)
    of_class = reps.join(roots, reps.rep == roots.node, "left").select("class", "id", F.coalesce("root", "rep").alias("root"))
    smallest = of_class.groupBy("root").agg(F.min("id").alias("component"))
    of_class = of_class.join(smallest, "root").select("class", "component", F.col("root").alias("_root"))
    out = signed.join(of_class, "class", "left").withColumn("component", F.coalesce("component", "rank_id"))
    doc = F.when(F.col("rank_id") == LAST_ID, F.lit(None).cast("long")).otherwise(F.col("rank_id"))
    out = out.select(doc.alias("doc_id"), "n_shingles", shown.alias("component_id"), (F.col("rank_id") == F.col("component")).alias("kept"), "_k", F.col("rank_id").alias("_rank"), "_root")
    out = materialize(out, "near-duplicates")  # a few numbers a document
    scratch.drop()
    return out


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: one with the smallest id. Rows of that id with other
    texts of the group, and further copies of the row, go as well; rows without shingles stay.
    All columns of ``docs`` stay, whatever their names."""
    own = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).where("kept")
    alone = own.where("_root is null").select("_k", "_rank").distinct().withColumn("_copies", F.lit(1).cast("long"))
    # kept rows of a component have the same id; the least key is one text of them
    copies = own.where("_root is not null").groupBy("_root", "_k", "_rank").agg(F.count("*").alias("_copies"))
    first = copies.groupBy("_root").agg(F.min("_k").alias("_k"))
    hashed, rank = unused(docs, "_kept_row_key"), unused(docs, "_kept_row_rank")
    kept = alone.unionByName(copies.join(first, ["_root", "_k"], "left_semi").select("_k", "_rank", "_copies")).withColumnsRenamed({"_k": hashed, "_rank": rank})
    ident = F.col(f"`{id_col}`").cast("long")
    rows = docs.withColumns({hashed: F.xxhash64(ident, F.col(f"`{text_col}`").cast("string")), rank: F.coalesce(ident, F.lit(LAST_ID))})
    once = rows.join(kept.where("_copies = 1").select(hashed, rank), [hashed, rank], "left_semi")
    several = kept.where("_copies > 1").select(hashed, rank)
    n = several.count()
    if n:  # a small table goes to the rows, so that copies are dropped before they move
        several = F.broadcast(several) if n <= 200_000 else several
        once = once.unionByName(rows.join(several, [hashed, rank], "left_semi").dropDuplicates([hashed, rank]))
    return once.drop(hashed, rank)
