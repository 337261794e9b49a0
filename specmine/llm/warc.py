"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans one partition for each stretch of a file between known
record starts (from the archive's manifest) or for each file. Comparisons of headers with
constants go down to the reader: headers are parsed first, and the payload of a record that fails,
or whose type isn't wanted, is neither decompressed nor copied (members written here carry
their sizes in a gzip extra field, so such members are skipped whole).

Predicates are bound to a frame by ``read_archive(..., where={header: values})``, which holds for
every use of it. Spark can also push a query's own filters (option ``pushdown``), but it keeps them
with the loaded frame and would serve its other scans from them; so that option is off unless
asked for, and is for frames that are scanned once.

``df.write.format("warc")`` writes gzip members, one a record, and lists the files of the
tasks that were committed in a manifest; what a lost or repeated task left is not read.

Paths may be of any file system that pyarrow knows; on a cluster they must be shared.

Defined results: a null payload is empty; equal payloads of equal ids are all responses; a
null id is the smallest; an archive without records gives no rows; one that ends within a record
is an error; line ends in a header value become spaces, nothing else of it is changed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from specmine.llm.common import unused

SCHEMA = "record_id string, type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
WRITES = "record_id string, type string, target_uri string, date string, refers_to string, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
MANIFEST = "_MANIFEST.json"
STRETCH = 16 << 20
LINE_END = re.compile(r"[\r\n]+")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing


def record_bytes(row: dict) -> bytes:
    payload = row["payload"] or b""
    revisit = row["type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = digest_of(payload) if column == "payload_digest" else row.get(column)
        if value is not None:
            value = f"sha1:{value}" if column == "payload_digest" else str(value)
            lines.append(f"{header}: " + LINE_END.sub(" ", value))
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field SL holds its own size and that of the data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str
    starts: list[int]
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = open_fs(self.path)
        fs.create_dir(top, recursive=True)
        name, starts, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in iterator:
                names = batch.schema.names
                columns = [batch.column(n) for n in names]
                for i in range(batch.num_rows):
                    data = member(record_bytes({n: c[i].as_py() for n, c in zip(names, columns)}))
                    if at - starts[-1] >= STRETCH:
                        starts.append(at)
                    out.write(data)
                    at += len(data)
        return Written(name, starts, at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = open_fs(self.path)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([[m.name, m.starts, m.size] for m in messages if m is not None and m.size]).encode())


# ---- reading


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int | None


def plan(path: str) -> list[Stretch]:
    fs, top = open_fs(path)
    info = fs.get_file_info(top)
    if info.type == pafs.FileType.File:
        return [Stretch(path, 0, None)]
    if fs.get_file_info(f"{top}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{top}/{MANIFEST}", compression=None) as f:
            files = json.loads(f.read())
        return [Stretch(f"{path}/{name}", a, b) for name, starts, size in files for a, b in zip(starts, [*starts[1:], size])]
    names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(top)) if x.base_name.endswith((".warc", ".warc.gz"))]
    return [Stretch(f"{path}/{n}", 0, None) for n in sorted(names)]


class Bytes:
    """A stretch of a file, read piece by piece; ``skip`` seeks."""

    def __init__(self, file, start: int, end: int | None):
        self.file, self.at, self.end = file, start, file.size() if end is None else end
        self.kept = b""
        file.seek(start)

    def fill(self, n: int) -> bytes:
        """At least n bytes from here, or what there is."""
        while len(self.kept) < n and self.at < self.end:
            got = self.file.read(min(max(n - len(self.kept), 1 << 18), self.end - self.at))
            if not got:
                break
            self.at += len(got)
            self.kept += got
        return self.kept

    def left(self) -> int:
        """Bytes from here to the end."""
        return len(self.kept) + self.end - self.at

    def drop(self, n: int) -> None:
        if n <= len(self.kept):
            self.kept = self.kept[n:]
        else:
            self.at += n - len(self.kept)
            self.kept = b""
            self.file.seek(self.at)


def headers_of(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Truncated(ValueError):
    """The archive ends within a record."""


def records(source: Bytes, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers of each record, and its block if ``wanted(headers)`` says so."""
    while source.fill(4).strip(b"\r\n"):
        if source.kept[:2] != b"\x1f\x8b":
            while (end := source.fill(1).find(b"\r\n\r\n")) < 0:
                before = len(source.kept)
                if len(source.fill(before + 1)) == before:
                    raise Truncated("the archive ends within a record's headers")
            headers = headers_of(source.kept[:end].lstrip(b"\r\n"))
            source.drop(end + 4)
            size, keep = int(headers.get("content-length", 0)), wanted(headers)
            if source.left() < size:
                raise Truncated("the archive ends within a record's block")
            yield headers, bytes(source.fill(size)[:size]) if keep else None
            source.drop(size)
            while source.fill(2)[:2] == b"\r\n":
                source.drop(2)
            continue
        head = source.fill(24)
        total = struct.unpack_from("<I", head, 16)[0] if head[3] & 4 and head[12:14] == b"SL" else 0
        packer, data, used = zlib.decompressobj(31), b"", 0
        headers: dict[str, str] | None = None
        keep = True
        while not packer.eof:
            piece = source.fill(used + (1 << 12 if headers is None else 1 << 16))[used : used + (1 << 12 if headers is None else 1 << 16)]
            if not piece:
                raise Truncated("the archive ends within a gzip member")
            data += packer.decompress(piece)
            used += len(piece)
            if headers is None and (end := data.find(b"\r\n\r\n")) >= 0:
                headers, data = headers_of(data[:end]), data[end + 4 :]
                keep = wanted(headers)
                if not keep and total:
                    break
            if headers is not None and not keep:
                data = b""
        if headers is None:
            raise Truncated("a gzip member without the end of a record's headers")
        size = int(headers.get("content-length", 0))
        if keep and len(data) < size:
            raise Truncated("a gzip member ends within a record's block")
        if total > source.left():
            raise Truncated("the archive ends within a gzip member")
        yield headers, data[:size] if keep else None
        source.drop(total or used - len(packer.unused_data))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, types: set[str] | None, verify: bool, pushdown: bool = False, where: dict[str, list[str]] | None = None):
        self.path, self.types, self.verify, self.pushdown = path, types, verify, pushdown
        self.tests: list[tuple[str, tuple]] = [(c, tuple(v)) for c, v in (where or {}).items()]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            yield f  # Spark tests again what comes out
            if not self.pushdown:
                continue
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in HEADERS and len(f.attribute) == 1:
                self.tests.append((column, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))

    def partitions(self) -> list[Stretch]:
        return plan(self.path) or [Stretch("", 0, 0)]

    def row_of(self, headers: dict[str, str]) -> dict:
        row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2].upper()
        return row

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = open_fs(partition.path)
        kinds = (*[pa.string()] * 6, pa.int64(), pa.binary())
        names = [*HEADERS, "payload_bytes", "payload"]
        out, size = [], 0

        def passes(headers: dict[str, str]) -> bool:
            row = self.row_of(headers)
            return all(row[c] in values for c, values in self.tests)

        def wanted(headers: dict[str, str]) -> bool:
            return passes(headers) and (self.types is None or headers.get("warc-type") in self.types)

        with fs.open_input_file(path) as file:
            for headers, block in records(Bytes(file, partition.start, partition.end), wanted):
                if not passes(headers):
                    continue
                row, payload = self.row_of(headers), None
                length = headers.get("warc-payload-length")
                if block is not None:
                    http = headers.get("content-type", "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    if row["type"] != "revisit":
                        length = len(payload)
                        if self.verify and row["payload_digest"] and digest_of(payload) != row["payload_digest"]:
                            raise ValueError(f"the payload of {row['record_id']} isn't that of its digest")
                out.append((*row.values(), None if length is None else int(length), payload))
                size += len(payload or b"")
                if size > 4 << 20 or len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


class WarcSource(DataSource):
    """Options: path; payloads (comma-separated record types whose payload is read, default all); verify
    (default true); where (JSON object of header columns and their wanted values); pushdown (default false:
    a query's own filters too, for frames that are scanned once)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        types = self.options.get("payloads")
        return WarcReader(self.options["path"], None if types is None else {t for t in types.split(",") if t}, self.options.get("verify", "true") == "true", self.options.get("pushdown") == "true", json.loads(self.options.get("where", "{}")))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archive(spark: SparkSession, path: str, *, where: dict[str, list[str]] | None = None, payloads: list[str] | None = None) -> DataFrame:
    """The records whose headers have the values of ``where`` (columns of ``HEADERS``), with the
    payloads of the record types named, of all if none are."""
    if unknown := {*(where or {})} - {*HEADERS}:
        raise ValueError(f"no header columns: {sorted(unknown)}")
    register(spark)
    reader = spark.read.format("warc").option("where", json.dumps(where or {}))
    return (reader if payloads is None else reader.option("payloads", ",".join(payloads))).load(path)


def mark_revisits(records: DataFrame, *, id_col: str, payload_col: str, out_col: str = "_original", min_bytes: int = 0) -> DataFrame:
    """``records`` with ``out_col``: the largest id of equal payloads of ``min_bytes`` or more, for
    the others of them; null for responses. Only digests and ids are grouped and joined among
    themselves; payloads move once, by id, so that a payload common to many is no hot key."""
    ident, payload = F.col(f"`{id_col}`"), F.col(f"`{payload_col}`")
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    digest = F.when(size >= min_bytes, F.sha1(F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))))
    narrow = records.select(ident.alias("id"), digest.alias("digest")).where("digest is not null")
    groups = narrow.groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    later = narrow.join(groups, "digest").where(~F.coalesce(F.col("id") == F.col("largest"), F.col("largest").isNull()))
    later = later.select(F.col("id").alias("_later_id"), F.col("digest").alias("_later_digest"), F.col("largest").alias(out_col)).distinct()
    rows, key = records.drop(out_col), unused(records, "_payload_digest")
    rows = rows.withColumn(key, digest)
    return rows.join(later, ident.eqNullSafe(F.col("_later_id")) & (F.col(key) == F.col("_later_digest")), "left").drop(key, "_later_id", "_later_digest")


def gunzip_all(data: bytes) -> bytes:
    """All members of an archive, for tests and small files."""
    return gzip.decompress(data)
