"""WARC archives as a PySpark data source named ``warc``.

Writing takes the columns of ``COLUMNS`` that the frame has and makes one file of
compressed records per task. Each record is a gzip member of its own whose extra
field ``sl`` holds the member's compressed and plain length. A file counts only once
the job's manifest lists it, so lost or repeated tasks leave no records behind.

Reading plans partitions from the sizes of the files (whole files, since members
cannot be found from the middle; small ones together). A task parses the header of a record first. Predicates on the type and
the other header columns are pushed down to it; for records that they reject, and for
all records if the schema that the reader asks for has no ``payload``, the rest of
the member is skipped by its length and never decoded (members of other writers,
which lack the length, are decoded to their end but not kept). Plain, uncompressed
files are read too; there a payload is skipped by the record's Content-Length.

The folder must be one that all executors reach, by a path or a URI that pyarrow
knows (file, hdfs, s3, gs). ``archived`` writes to the folder that
``spark.checkpoint.dir`` names.

Defined results: a missing payload of a response is empty; a revisit has no payload
and keeps the digest and the length of the one it refers to. Missing headers are
null. An empty frame makes an archive without records. Repeated rows are records of their
own; of equal payloads, ties go to the largest id, and rows of one id and payload are
alike. A very long payload is one record, in memory once while it is written or read.
Records that are not HTTP
messages (resource, conversion) have their block as payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from ..session import scratch_path

COLUMNS = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary"
)
#: Fixed values of the format: header names by column, and a revisit's profile.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_ONLY = {"record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to"}
PACK = 64 << 20
BATCH = 8 << 20
END = b"\r\n\r\n"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/*", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _hex(digest: str | None) -> str | None:
    """A digest header as bare lower-case hex; SHA-1 comes in base 32 as a rule."""
    if digest is None:
        return None
    value = digest.partition(":")[2] or digest
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def member(head: bytes, body: bytes, level: int) -> bytes:
    """A gzip member with its lengths in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(head) + packer.compress(body) + packer.flush()
    plain = len(head) + len(body)
    start = struct.pack("<4BI2BH2sH", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8)
    length = len(start) + 8 + len(packed) + 8
    crc = zlib.crc32(body, zlib.crc32(head))
    return b"".join((start, struct.pack("<2I", length, plain), packed, struct.pack("<2I", crc, plain & 0xFFFFFFFF)))


def record(row: dict, level: int) -> bytes:
    """One response or revisit record, compressed."""
    kind = row.get("record_type") or "response"
    payload = (row.get("payload") or b"") if kind != "revisit" else b""
    digest = row.get("payload_digest")
    size = row.get("payload_bytes")
    if kind != "revisit":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size or 0}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(row.get('record_id') or uuid.uuid4().urn)}>"]
    lines.append(f"WARC-Date: {_clean(row.get('date') or '1970-01-01T00:00:00Z')}")
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if digest:
        lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        if row.get("refers_to") is not None:
            lines.append(f"WARC-Refers-To: <{_clean(row['refers_to'])}>")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return member("\r\n".join(lines).encode() + END + http, payload + END, level)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level, self.job = path, level, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _located(self.path)
        store.create_dir(folder, recursive=True)
        name, count = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for at in range(batch.num_rows):
                    row = {name: column[at].as_py() for name, column in zip(batch.schema.names, columns)}
                    out.write(record(row, self.level))
                    count += 1
        return Written(name, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _located(self.path)
        store.create_dir(folder, recursive=True)
        names = [m.name for m in messages if m is not None and m.records]
        with store.open_output_stream(f"{folder}/_files-{self.job}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _located(self.path)
        for message in messages:
            if message is not None:
                store.delete_file(f"{folder}/{message.name}")


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


class Stream:
    """A file's bytes, buffered, with the position of the next one."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def more(self, size: int = 1 << 18) -> bool:
        new = self.file.read(size)
        self.held = self.held[self.at :] + new
        self.at = 0
        return bool(new)

    def need(self, size: int) -> bool:
        while len(self.held) - self.at < size:
            if not self.more(max(1 << 18, size)):
                return False
        return True

    def take(self, size: int) -> bytes:
        self.need(size)
        out = self.held[self.at : self.at + size]
        self.at += len(out)
        return out

    def skip(self, size: int) -> None:
        left = size - (len(self.held) - self.at)
        if left <= 0:
            self.at += size
        else:
            self.held, self.at = b"", 0
            self.file.seek(left, 1)


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields


class Member:
    """The plain bytes of the gzip member that starts at a stream's position."""

    def __init__(self, stream: Stream):
        self.stream, self.out, self.used = stream, b"", 0
        self.unpack = zlib.decompressobj(31)
        self.length = None
        stream.need(24)
        head = stream.held[stream.at : stream.at + 24]
        if len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00":
            self.length = struct.unpack("<I", head[16:20])[0]

    def _pull(self) -> bool:
        """Decode some more; false at the member's end."""
        if self.unpack.eof:
            return False
        stream = self.stream
        if stream.at == len(stream.held) and not stream.more():
            return False
        # Compressed input in small steps, so a header costs little.
        part = stream.held[stream.at : stream.at + 4096]
        self.out += self.unpack.decompress(part)
        took = len(part) - len(self.unpack.unused_data)
        stream.at += took
        self.used += took
        return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.out:
            if not self._pull():
                return None
        found, _, self.out = self.out.partition(mark)
        return found

    def take(self, size: int) -> bytes:
        parts, held = [self.out], len(self.out)
        self.out = b""
        while held < size and self._pull():
            parts.append(self.out)
            held += len(self.out)
            self.out = b""
        whole = b"".join(parts)
        self.out = whole[size:]
        return whole[:size]

    def finish(self) -> None:
        if self.length is not None:
            self.stream.skip(self.length - self.used)
            return
        while self._pull():
            self.out = b""


class Plain(Member):
    """The same for a record of an uncompressed file."""

    def __init__(self, stream: Stream):
        self.stream, self.out, self.left = stream, b"", None

    def _pull(self) -> bool:
        if self.stream.at == len(self.stream.held) and not self.stream.more():
            return False
        self.out += self.stream.take(min(4096, len(self.stream.held) - self.stream.at))
        return True

    def finish(self) -> None:
        pass


def records(file, wanted, with_payload: bool, gzipped: bool) -> Iterator[dict]:
    """The records of a file whose header columns ``wanted`` accepts."""
    stream = Stream(file)
    while stream.need(1):
        body = Member(stream) if gzipped else Plain(stream)
        head = body.until(END)
        if head is None:
            break
        version, fields = _headers(head.lstrip(b"\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        size = int(fields.get("content-length", 0))
        row = {name: fields.get(header.lower()) for name, header in HEADERS.items()}
        row["payload_digest"] = _hex(row["payload_digest"])
        for name in ("record_id", "refers_to"):
            row[name] = row[name] and row[name].strip("<>")
        row["payload_bytes"] = row["payload"] = None
        start = size
        if wanted(row):
            if "application/http" in fields.get("content-type", ""):
                http = body.until(END) or b""
                start = size - len(http) - len(END)
                length = _headers(http)[1].get("content-length")
                row["payload_bytes"] = int(length) if row["record_type"] == "revisit" and length else start
            else:
                row["payload_bytes"] = size
            if with_payload and row["record_type"] != "revisit":
                row["payload"] = body.take(start)
                start = 0
            yield row
        if not gzipped:
            held = len(body.out)
            stream.at -= held
            stream.skip(start + len(END))
        body.finish()


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.names
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on header columns are applied before a payload is decoded."""
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            kind = {EqualTo: "is", In: "in", StringStartsWith: "starts", IsNotNull: "has"}.get(type(one))
            if column in HEADER_ONLY and kind:
                self.filters.append((column, kind, getattr(one, "value", None)))
            else:
                yield one

    def partitions(self) -> list[Files]:
        store, folder = _located(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File]
        lists = [x for x in found if re.search(r"/_files-[^/]*\.json$", x.path)]
        files = sorted((x for x in found if re.search(r"\.warc(\.gz)?$", x.path)), key=lambda x: x.path)
        if lists:
            kept = set()
            for one in lists:
                with store.open_input_stream(one.path) as text:
                    kept.update(json.loads(text.read()))
            files = [x for x in files if x.base_name in kept]
        parts, held = [], 0
        for file in files:
            if not parts or held + file.size > PACK:
                parts.append([])
                held = 0
            parts[-1].append(file.path)
            held += file.size
        return [Files(names) for names in parts] or [Files([])]

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            own = row[column]
            if own is None:
                return False
            if kind == "is" and own != value or kind == "in" and own not in value:
                return False
            if kind == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _located(self.path)
        arrow = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        held: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([row[n] for row in held], arrow.get(n, pa.string())) for n in self.names]
            return pa.RecordBatch.from_arrays(columns, names=self.names)

        for path in partition.names:
            with store.open_input_file(path) as file:
                for row in records(file, self.wanted, "payload" in self.names, path.endswith(".gz")):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > BATCH:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class WarcSource(DataSource):
    """Options: ``path``; ``level`` of compression (default 1)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("an archive is only added to")
        return Writer(self.options["path"], int(self.options.get("level", "1")))


def read_warc(spark: SparkSession, path: str, columns: str = COLUMNS) -> DataFrame:
    """The records of a folder; leave ``payload`` out of ``columns`` to skip payloads."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Records for pages (``record, url, payload``), equal payloads stored once.

    Of equal payloads of at least ``least`` bytes the one with the largest ``record``
    stays a response, all others are revisits of it. Digests meet as counted groups;
    only those that repeat are joined back.
    """
    told = pages.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = told.where(F.col("payload_bytes") >= least)
    shared = large.groupBy("payload_digest").agg(F.max("record").alias("kept"), F.count("*").alias("rows"))
    path = scratch_path(pages.sparkSession, "warc-shared")
    shared.where("rows > 1").select("payload_digest", "kept").write.parquet(path)
    shared = pages.sparkSession.read.schema("payload_digest string, kept long").parquet(path)
    joined = told.join(shared, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least) & F.col("kept").isNotNull() & ~F.col("record").eqNullSafe(F.col("kept"))
    return joined.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("record").cast("string"), F.lit(""))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), "payload_digest", "payload_bytes",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("kept").cast("string"))).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write pages (``record, url, payload``) to an archive in the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "archive")
    write_warc(with_revisits(pages), path)
    return read_warc(pages.sparkSession, path)


def query(pages: DataFrame) -> DataFrame:
    plain = pages.select(
        F.col("page_id").cast("long").alias("record"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    back = archived(plain)

    def page(column: str) -> Column:
        return F.nullif(F.substring_index(F.col(column), ":", -1), F.lit("")).cast("long")

    read = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(read, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


ORACLE = r"""
WITH plain AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), told AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM plain
), kept AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM told
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM kept
"""
