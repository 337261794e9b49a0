"""Texts as files of their own, written by tasks to the shared folder and read back by the file source."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = 200_000  # at once: the driver lists them, and each takes a block of the disk
FOLDERS = 64


def local_path(path: str) -> str | None:
    """The path that all see where the folder is a local (or mounted) one."""
    return None if "://" in path and not path.startswith("file:") else "/" + path.removeprefix("file:").lstrip("/")


def whole_texts(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(file, value): the text of each file of such a name, uncompressed ones. The text source copies all of Hadoop's settings
    for each file that it reads whole; the binary one doesn't."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("content").cast("string").alias("value"))


def write_each(rows: DataFrame, path: str) -> None:
    """A file ``part-<task>-<name>`` of each (name, text), with a line's end behind the text, dealt over FOLDERS folders of ``path``.

    Without native libraries, Hadoop's local file system starts a process for each file it makes, so local files are
    written by Python workers: under another name first, so that an attempt that is repeated leaves whole files alone.
    Folders of other kinds get Spark's own part files.
    """
    top = local_path(path)
    dealt = rows.repartition(FOLDERS, "name")  # files cost more than bytes: small texts would all be written by one task
    if top is None:
        dealt.select(F.pmod(F.xxhash64("name"), F.lit(FOLDERS)).alias("folder"), "text").repartition(FOLDERS, "folder").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("folder").text(path)
        return

    for folder in range(FOLDERS):
        os.makedirs(f"{top}/{folder}", exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                folder, own = f"{top}/{crc32(name.encode()) % FOLDERS}", f".{uuid.uuid4().hex}"
                with open(f"{folder}/{own}", "wb") as file:
                    file.write(f"{text}\n".encode())
                os.replace(f"{folder}/{own}", f"{folder}/part-{task:05d}-{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    dealt.select("name", "text").mapInArrow(run, "n bigint").agg(F.sum("n")).first()


def remove(spark: SparkSession, path: str) -> None:
    top = local_path(path)
    if top is not None:
        spark.sparkContext.parallelize(range(FOLDERS), FOLDERS).foreach(lambda folder: shutil.rmtree(f"{top}/{folder}", ignore_errors=True))
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole.getFileSystem(spark._jsc.hadoopConfiguration()).delete(whole, True)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Within it, a task reads some 2,000 small files, not 32."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 10))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def through_files(rows: DataFrame, top: str, read: Callable[[str], DataFrame], limit: int = FILES) -> DataFrame:
    """What ``read`` gives of the folders in which each of ``rows`` (name, text) is a file of its own. ``top`` is a new folder
    among the shared ones. Beyond ``limit`` files, about so many are there at once: they are read into a table and go before
    the next are written."""
    spark = rows.sparkSession
    rows.write.parquet(f"{top}/texts")
    rows = spark.read.schema(rows.schema).parquet(f"{top}/texts")
    n = max(1, -(-rows.count() // limit))
    if n > 1:
        part = F.pmod(F.xxhash64("name", F.lit("part")), F.lit(n)).cast("int")
        rows.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{top}/parts")
    for i in range(n):
        path = f"{top}/files{i}"
        write_each(spark.read.schema("name string, text string, part int").parquet(f"{top}/parts").where(F.col("part") == i) if n > 1 else rows, path)
        with small_files(spark):
            got = read(f"{path}/*")
            got.write.mode("append").parquet(f"{top}/read")
        if n > 1:
            remove(spark, path)
    return spark.read.schema(got.schema).parquet(f"{top}/read")
