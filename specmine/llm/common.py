"""What the operators of this folder share: the shared folder, materialising, byte hashing.

Rows are told apart by ``_k`` = xxhash64(id, text), so repeated ids and null ids need no
special case: rows that are equal in both get equal results, and a null id sorts last.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark
    runs in this one process (tests). A cluster without the setting is an error."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(top)
    return top.rstrip("/")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends: for results that are written
    or collected once, so that the disk holds one step's files at a time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/specmine-{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one call in a folder of their own in the shared folder, dropped together."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/specmine-{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        with cleaned(self.spark):
            df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def drop(self) -> None:
        """Only once nothing lazy reads the tables any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the row key; other columns (whatever their names) are left behind."""
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return docs.select(ident.alias("doc_id"), text.alias("text")).withColumn("_k", F.xxhash64("doc_id", "text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores added as it takes to be no column of ``df``."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in the whole table: one small aggregate, used to size buckets."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in a string or binary column, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = np.concatenate(([0], np.cumsum(sizes)[:-1])) // limit if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    kind = pa.large_binary() if column.type in (pa.large_string(), pa.large_binary()) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


# ---- hashing of bytes, vectorised -------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def kmer_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size k, an unmixed hash of the k bytes from every position (k <= len(data))."""
    level, width, at = BYTE[data], 1, [None] * len(sizes)
    parts: list[list[tuple[np.ndarray, int]]] = [[] for _ in sizes]
    done = [0] * len(sizes)
    while width <= max(sizes):
        for j, k in enumerate(sizes):
            if k & width:
                n = len(data) - k + 1
                # low bits first: the part of this width starts behind the parts already taken
                piece = level[done[j] : done[j] + n]
                at[j] = piece.copy() if at[j] is None else at[j] * _power(width) + piece
                done[j] += width
        if 2 * width <= max(sizes):
            level = level[: len(level) - width] * _power(width) + level[width:]
        width *= 2
    return at


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    width, level = 1, values
    while 2 * width <= w:
        level = np.minimum(level[: len(level) - width], level[width:])
        width *= 2
    n = len(values) - w + 1
    return np.minimum(level[:n], level[w - width : w - width + n])


def word_hashes(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every maximal run of bytes that aren't separators (a 256-entry table)."""
    sep = np.concatenate(([True], separator[data], [True]))
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up, dtype=np.uint64)))
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and its inverse for i below n, kept for the next call."""
    if len(_powers[0]) < n:
        size = -(-n // (1 << 18)) << 18
        for j, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[j] = np.cumprod(x, dtype=np.uint64)
    return [_powers[0][:n], _powers[1][:n]]
