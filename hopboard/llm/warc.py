"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions of whole files, small ones together up to `maxPartitionBytes`. Of every record
the headers are parsed first. Filters on the record type and on headers are evaluated there, and the
payload is only decoded for records that pass, or not at all with the option `payload` set to false.
Archives of this writer hold one gzip member per record with its length in an `sl` extra field, so that
a record that is not wanted is skipped without inflating it. Members of other writers may have no such field
or hold several records; they are inflated to their end, unwanted records without being kept. Plain `.warc` files are skipped by Content-Length.

Writing goes through a file per task attempt, with a new name. The files count once the driver has written
a manifest that lists those of the attempts that succeeded; a folder without manifest is read whole.
Paths are opened by pyarrow's file systems (local, HDFS, S3, GCS), not through the driver.

Defined cases: a null payload is empty; null headers are left out and read as null; line breaks in header
values are percent-encoded. A revisit record holds no payload. A response without end of its HTTP headers is payload
as a whole. Empty input gives an empty archive. Broken and cut-off records, and bytes that are no record, raise with
file and offset.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from hopboard.llm.common import with_facts, written

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, content_length bigint, "
    "payload_length bigint, payload_digest string, refers_to string, payload binary, file string, offset bigint"
)
# Columns with the header each one is read from and written to.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_length": "WARC-X-Payload-Length",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
NUMBERS = ("content_length", "payload_length")
PARTITION_BYTES = 128 << 20
SMALLEST_PARTITION = 4 << 20
FILE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARROW = pa.schema([
    *[(name, pa.int64() if name in NUMBERS else pa.string()) for name in HEADERS],
    ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def file_system(location: str) -> tuple[pafs.FileSystem, str]:
    if "://" in location:
        return pafs.FileSystem.from_uri(location)
    path = location.removeprefix("file:")
    return pafs.LocalFileSystem(), path


# Writing


def member(record: bytes, level: int) -> bytes:
    """One gzip member with its own length and that of the record in an `sl` field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    known = length < 1 << 32 and len(record) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, length if known else 0, len(record) if known else 0)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(values: dict) -> bytes:
    payload = values.get("payload") or b""
    kind = values.get("record_type") or "resource"
    if kind in ("response", "revisit"):
        block = _HTTP % (values.get("payload_length") if values.get("payload_length") is not None else len(payload))
        block += payload if kind == "response" else b""
        values = {**values, "content_type": "application/http; msgtype=response"}
    else:
        block = payload
    lines = [b"WARC/1.1"]
    for name, header in HEADERS.items():
        value = len(block) if name == "content_length" else values.get(name)
        if value is not None:
            lines.append(f"{header}: {_one_line(str(value))}".encode())
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, location: str, level: int, overwrite: bool):
        self.location, self.level, self.overwrite = location, level, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.location)
        system.create_dir(path, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for values in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                    info = {"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid4()}>", "date": DATE, "content_type": "application/warc-fields"}
                    out.write(member(record_bytes({**info, "payload": b"format: WARC File Format 1.1\r\n"}), self.level))
                data = member(record_bytes(values), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.location)
        system.create_dir(path, recursive=True)
        older = [info.path for info in system.get_file_info(pafs.FileSelector(path)) if _is_manifest(info)] if self.overwrite else []
        name = f"_manifest-{uuid4().hex}.json"
        with system.open_output_stream(f"{path}/.{name}", compression=None) as out:
            out.write(json.dumps([file for message in messages if message for file in message.files]).encode())
        for manifest in older:
            system.delete_file(manifest)
        system.move(f"{path}/.{name}", f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.location)
        for file in (file for message in messages if message for file in message.files):
            system.delete_file(f"{path}/{file}")


def _is_manifest(info: pafs.FileInfo) -> bool:
    return info.base_name.startswith("_manifest-")


# Reading


@dataclass
class Files(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class Input:
    """A file read forwards, of which stretches can be left out."""

    def __init__(self, source: pa.NativeFile, chunk: int = 1 << 18):
        self.source, self.chunk, self.size = source, chunk, source.size()
        self.start, self.buffer = 0, b""

    def peek(self, n: int, at: int) -> bytes:
        """Up to n bytes from a place that is not before that of the last call."""
        if at > self.start:
            held = self.buffer[at - self.start :] if at < self.start + len(self.buffer) else b""
            self.start, self.buffer = at, held
        missing = n - len(self.buffer)
        end = self.start + len(self.buffer)
        if missing > 0 and end < self.size:
            self.source.seek(end)
            self.buffer += self.source.read(max(missing, self.chunk))
        return self.buffer[:n]


class Member:
    """One gzip member, inflated as far as it is asked for; what has been read is dropped."""

    def __init__(self, source: Input, at: int):
        self.source, self.at, self.next = source, at, at
        self.inflate, self.data, self.used = zlib.decompressobj(31), b"", 0
        head = source.peek(65_549, at)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.packed, self.unpacked = _lengths(head)

    def head(self) -> bytes:
        """Up to the next empty line, which is left out."""
        searched = 0
        while (found := self.data.find(_EMPTY_LINE, max(0, searched - len(_EMPTY_LINE)))) < 0:
            searched = len(self.data)
            if not self._more(4096):
                raise ValueError("record without end of headers")
        return self._take(found + len(_EMPTY_LINE))[:found]

    def block(self, n: int, wanted: bool) -> bytes:
        """The next n bytes, or none of them if they are not wanted."""
        parts = []
        while n:
            if not self.data and not self._more(1 << 20):
                raise ValueError("truncated record")
            piece = self._take(min(n, len(self.data)))
            n -= len(piece)
            if wanted:
                parts.append(piece)
        return b"".join(parts)

    def is_last(self, length: int) -> bool:
        """Whether a record with a block of this length, not read yet, ends the member by the length in its header."""
        return bool(self.packed) and self.used + length + 4 == self.unpacked

    def skip_line_ends(self) -> bool:
        """Skip line ends after a record; whether anything follows."""
        while True:
            kept = self.data.lstrip(b"\r\n")
            self._take(len(self.data) - len(kept))
            if self.data:
                return True
            if not self._more(4096):
                return False

    def end(self) -> int:
        """Where the next member starts, once this one is read or known to be at its last record."""
        return self.next - len(self.inflate.unused_data) if self.inflate.eof else self.at + self.packed

    def _take(self, n: int) -> bytes:
        taken, self.data = self.data[:n], self.data[n:]
        self.used += n
        return taken

    def _more(self, n: int) -> bool:
        while not self.inflate.eof:
            fed = self.inflate.unconsumed_tail
            if not fed:
                fed = self.source.peek(1 << 16, self.next)
                self.next += len(fed)
                if not fed:
                    raise ValueError("truncated member")
            if piece := self.inflate.decompress(fed, n):
                self.data += piece
                return True
        return False


# Fixed value: what ends the headers of a record.
_EMPTY_LINE = b"\r\n\r\n"


def _lengths(head: bytes) -> tuple[int, int]:
    """Length of a gzip member and of what is in it, by its `sl` field; 0 and 0 if it has none."""
    if head[3] & 4:
        size = struct.unpack_from("<H", head, 10)[0]
        extra, at = head[12 : 12 + size], 0
        while at + 4 <= len(extra):
            length = struct.unpack_from("<H", extra, at + 2)[0]
            if extra[at : at + 2] == b"sl" and length == 8 and at + 12 <= len(extra):
                return struct.unpack_from("<II", extra, at + 4)
            at += 4 + length
    return 0, 0


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def record_columns(headers: dict[str, str]) -> dict:
    values = {name: headers.get(header.lower()) for name, header in HEADERS.items()}
    return {name: int(value) if value is not None and name in NUMBERS else value for name, value in values.items()}


def payload_of(kind: str | None, block: bytes) -> bytes | None:
    if kind == "revisit":
        return None
    if kind == "response" and block.startswith(b"HTTP/"):
        head, end, payload = block.partition(_EMPTY_LINE)
        return payload if end else head
    return block


def read_file(location: str, tests: list, with_payload: bool) -> Iterator[dict]:
    """Records of one file that pass all tests on their header columns.

    `offset` is the place of the record, or of the gzip member that it is in.
    """
    system, path = file_system(location)
    with system.open_input_file(path) as opened:
        source, at = Input(opened), 0
        packed = source.peek(2, 0) == b"\x1f\x8b"

        def wanted(values: dict) -> bool:
            return all(test(values) for test in tests)

        while at < source.size:
            try:
                if packed:
                    member = Member(source, at)
                    for values, block in _in_member(member, wanted, with_payload):
                        yield {**values, "payload": block, "file": location, "offset": at}
                    at = member.end()
                else:
                    values, block, following = _plain_record(source, at, wanted, with_payload)
                    if values is not None:
                        yield {**values, "payload": block, "file": location, "offset": at}
                    at = following
            except (ValueError, zlib.error, struct.error) as error:
                raise ValueError(f"{location} at {at}: {error}") from error


def _in_member(member: Member, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Wanted records of a gzip member, of which there may be any number; its end is reached or known afterwards."""
    while member.skip_line_ends():
        values = record_columns(parse_headers(member.head()))
        length, needed = values["content_length"] or 0, wanted(values)
        decoded = needed and with_payload and values["record_type"] != "revisit"
        if not decoded and member.is_last(length):
            if needed:
                yield values, None
            return
        block = member.block(length, decoded)
        if needed:
            yield values, payload_of(values["record_type"], block) if decoded else None


def _plain_record(source: Input, at: int, wanted, with_payload: bool) -> tuple[dict | None, bytes | None, int]:
    """Columns of a record, None if it is not wanted, its payload, and where the next one starts."""
    size = 4096
    while (found := (head := source.peek(size, at)).find(_EMPTY_LINE)) < 0:
        if len(head) < size:
            raise ValueError("record without end of headers")
        size *= 2
    values = record_columns(parse_headers(head[:found]))
    body, length = at + found + 4, values["content_length"] or 0
    if body + length > source.size:
        raise ValueError("truncated record")
    if not wanted(values):
        return None, None, body + length + 4
    return values, payload_of(values["record_type"], source.peek(length, body)) if with_payload else None, body + length + 4


_COMPARISONS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
    In: lambda a, b: a in b,
}


@dataclass
class HeaderTest:
    """A pushed filter on one header column. Null passes none but IS NULL and the null-safe comparison."""

    column: str
    kind: type
    value: object = None
    negated: bool = False

    def __call__(self, values: dict) -> bool:
        value = values[self.column]
        if self.kind is IsNull:
            return (value is None) != self.negated
        if self.kind is EqualNullSafe:
            return (value == self.value) != self.negated
        return value is not None and _COMPARISONS[self.kind](value, self.value) != self.negated


def header_test(item: Filter) -> HeaderTest | None:
    """The test for a filter, or none if Spark has to evaluate it."""
    if isinstance(item, Not):
        inner = header_test(item.child)
        return inner and HeaderTest(inner.column, inner.kind, inner.value, not inner.negated)
    column = getattr(item, "attribute", ())
    if len(column) != 1 or column[0] not in HEADERS:
        return None
    if isinstance(item, IsNotNull):
        return HeaderTest(column[0], IsNull, negated=True)
    if isinstance(item, (IsNull, EqualNullSafe)):
        return HeaderTest(column[0], type(item), getattr(item, "value", None))
    if type(item) in _COMPARISONS and getattr(item, "value", None) is not None:
        value = item.value
        if isinstance(value, (list, tuple)):
            # NOT IN a list with a null is never true; leave such a list to Spark.
            return None if None in value else HeaderTest(column[0], type(item), tuple(value))
        return HeaderTest(column[0], type(item), value)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, location: str, with_payload: bool, partition_bytes: int, cores: int = 1):
        self.location, self.with_payload, self.partition_bytes, self.cores = location, with_payload, partition_bytes, max(1, cores)
        self.tests: list[HeaderTest] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for item in filters:
            test = header_test(item)
            if test is None:
                yield item
            else:
                self.tests.append(test)

    def partitions(self) -> Sequence[Files]:
        """Files put together up to the size of a partition, which is smaller where there are cores to spare."""
        sizes = list_files(self.location)
        groups: list[list[str]] = []
        room = 0
        share = max(SMALLEST_PARTITION, sum(size for _, size in sizes) // self.cores)
        most = min(self.partition_bytes, share)
        for file, size in sizes:
            if size > room or not groups:
                groups.append([])
                room = most
            groups[-1].append(file)
            room -= size
        return [Files(group) for group in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file in partition.files if isinstance(partition, Files) else []:
            for row in read_file(file, self.tests, self.with_payload):
                rows.append(row)
                size += 500 + len(row["payload"] or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def list_files(location: str) -> list[tuple[str, int]]:
    """Archives at a location with their sizes: a file, those in the manifests of a folder, or all of it."""
    system, path = file_system(location)
    info = system.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(location, info.size)]
    found = system.get_file_info(pafs.FileSelector(path))
    manifests = [info.path for info in found if _is_manifest(info)]
    listed: set[str] = set()
    for manifest in manifests:
        with system.open_input_stream(manifest, compression=None) as opened:
            listed |= set(json.loads(opened.read()))
    archives = [info for info in found if info.base_name.endswith((".warc", ".warc.gz")) and (not manifests or info.base_name in listed)]
    return sorted((f"{location.rstrip('/')}/{info.base_name}", info.size) for info in archives)


class WarcDataSource(DataSource):
    """Options: `path`, `payload` (true), `maxPartitionBytes`, `cores` to read with (1), `level` of compression (6)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        payload = str(self.options.get("payload", "true")).lower() == "true"
        return WarcReader(
            self.options["path"], payload, int(self.options.get("maxPartitionBytes", PARTITION_BYTES)), int(self.options.get("cores", 1))
        )

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 6)), overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    cores = spark.sparkContext.defaultParallelism
    return spark.read.format("warc").option("payload", str(payload).lower()).option("cores", cores).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode(mode).option("path", path).save()


# Pages

# Fixed value: the digits of base 32.
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """A record per page (page_id, url, html): of equal payloads, all but that of the largest page_id revisit it.

    Payloads of fewer than `least_bytes` are all responses. Ids are whole numbers. Pages without id revisit a page with one, if any
    has the same payload, and are responses otherwise; pages that share the largest id are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_length": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")}
    )
    # A payload of very many pages is looked up where these are; the rest is brought together by digest.
    repeated = written(
        rows.where(F.col("payload_length") >= least_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "repeated",
    )
    revisits = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    urn = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))
    return with_facts(rows, repeated, "digest", "n", "left").select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        "payload_length",
        F.concat(F.lit("sha1:"), _base32(F.col("digest"))).alias("payload_digest"),
        F.when(revisits, urn("latest")).alias("refers_to"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def _base32(hexadecimal: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: eight signs for each ten digits."""
    signs = F.lit(_SIGNS)
    parts = []
    for start in range(1, 41, 10):
        number = F.conv(F.substring(hexadecimal, start, 10), 16, 10).cast("bigint")
        parts += [F.substr(signs, (F.shiftright(number, 5 * place).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for place in range(7, -1, -1)]
    return F.concat(*parts)


def hex_digest(label: Column) -> Column:
    """Hexadecimal digits of a digest written as `sha1:` and base 32: ten for each eight signs."""
    text = F.regexp_replace(label, "^sha1:", "")
    value = lambda at: (F.position(F.substring(text, at, 1), F.lit(_SIGNS)) - 1).cast("bigint")
    parts = []
    for start in range(1, 33, 8):
        number = sum((value(start + place) * 32 ** (7 - place) for place in range(1, 8)), value(start) * 32**7)
        parts.append(F.lpad(F.lower(F.hex(number)), 10, "0"))
    return F.concat(*parts)


def page_facts(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of the payload itself where it is there."""
    page = lambda column: F.nullif(F.regexp_extract(column, "^<urn:page:(.*)>$", 1), F.lit("")).cast("bigint")
    here = F.col("payload").isNotNull()
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"),
        F.when(here, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(here, F.sha1("payload")).otherwise(hex_digest(F.col("payload_digest"))).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
