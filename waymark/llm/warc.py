"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files by their sizes, takes equality and
comparison filters on the header columns down into the reader, parses the headers
of each record first, and decodes a payload only where the record passes the
filters and its payload is wanted (option ``payload``: all, response, none).

Archives are written a gzip member a record, with the extra field "sl" of the WARC
standard that holds the member's compressed and uncompressed length, so that a reader
steps over a record it does not want after decompressing the first bytes. Members
without the field, members of several records, and archives that are not compressed
are read too, front to back, whatever they hold in memory bounded by one record.
Digests are verified where they are SHA-1 in base32 of the payload as it is stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
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

from waymark.storage import materialize, scratch_path

#: What a record has. payload_bytes is the length of the full payload, of a revisit's response too.
RECORD = "page_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
INPUT = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload")
PARTITION_BYTES = 64 << 20
_HEAD = 4096
_ID = "urn:page:"
_ESCAPED = "Waymark-Escaped-Target-URI"
_SHA1 = re.compile("sha1:[A-Z2-7]{32}")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def member(data: bytes) -> bytes:
    """A gzip member whose extra field holds its lengths, unless they are too large for it."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    length = 12 + 12 + len(packed) + 8
    end = packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(length, len(data)) >> 32:
        return b"\x1f\x8b\x08\0" + b"\0" * 4 + b"\0\xff" + end
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length, len(data)) + end


def _clean(value: str) -> str:
    """A header value on one line: percent escapes for line ends, for white space around it, and for the percent sign."""
    inner = value.strip()
    at = value.find(inner) if inner else len(value)
    return "".join(quote(c, safe="") if c in "%\r\n" or not at <= i < at + len(inner) else c for i, c in enumerate(value))


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, name: str, payload: bytes) -> bytes:
    """A response or revisit record; a revisit holds the HTTP headers of its response, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        # other writers' readers see an address as it is; only what no header can hold is escaped, and marked
        plain = url == url.strip() and "\r" not in url and "\n" not in url
        lines += [f"WARC-Target-URI: {url}"] if plain else [f"WARC-Target-URI: {_clean(url)}", f"{_ESCAPED}: percent"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{name}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """WARC headers, lower-cased names, and where the block starts; None while they are not complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def _complete(data: bytes, parsed: tuple[dict[str, str], int] | None) -> bool:
    """Whether a record's beginning holds all its headers, those of HTTP too."""
    if parsed is None:
        return False
    head, start = parsed
    return not head.get("content-type", "").startswith("application/http") or data.find(b"\r\n\r\n", start) >= 0


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits.lstrip("-").isdigit() else None


def columns(head: dict[str, str], block: bytes) -> dict:
    """A record's columns without its payload. block: its beginning at least, for the length of the payload."""
    size = None
    if head.get("content-type", "").startswith("application/http"):
        for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                size = int(line.split(b":")[1])
    if size is None:
        size = int(head.get("content-length", 0))
    uri = head.get("warc-target-uri")
    return {
        "page_id": _number(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": unquote(uri) if uri is not None and _ESCAPED.lower() in head else uri,
        "refers_to": _number(head.get("warc-refers-to")), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": size,
    }


def body_of(head: dict[str, str], block: bytes) -> bytes:
    """The payload: what follows the HTTP headers, or the whole block."""
    return block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


_TESTS = {
    EqualTo: lambda a, b: a is not None and a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a is not None and a in b,
    GreaterThan: lambda a, b: a is not None and a > b, GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b,
    IsNull: lambda a, b: a is None, IsNotNull: lambda a, b: a is not None,
    StringContains: lambda a, b: a is not None and b in a, StringStartsWith: lambda a, b: a is not None and a.startswith(b), StringEndsWith: lambda a, b: a is not None and a.endswith(b),
}


def _passes(row: dict, tests: list) -> bool:
    for test in tests:
        inner, wanted = (test.child, False) if isinstance(test, Not) else (test, True)
        value = row[inner.attribute[0]]
        if not wanted and value is None and not isinstance(inner, (IsNull, IsNotNull, EqualNullSafe)):
            return False
        if _TESTS[type(inner)](value, getattr(inner, "value", None)) != wanted:
            return False
    return True


def _supported(f) -> bool:
    inner = f.child if isinstance(f, Not) else f
    return type(inner) in _TESTS and len(inner.attribute) == 1 and inner.attribute[0] in ("page_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes")


class _Unzipped:
    """The content of one gzip member, read forwards; what lies before the last place asked for is forgotten."""

    def __init__(self, read: Callable[[int, int], bytes], at: int) -> None:
        self.read, self.next, self.zip = read, at, zlib.decompressobj(31)
        self.buffer, self.base = b"", 0

    def _more(self, most: int) -> bytes:
        data = self.zip.unconsumed_tail
        if not data:
            data = self.read(self.next, 1 << 16)
            self.next += len(data)
            if not data:
                raise ValueError("an archive that ends within a member")
        return self.zip.decompress(data, most)

    def __call__(self, at: int, n: int) -> bytes:
        while not self.zip.eof and at + n > self.base + len(self.buffer):
            skip = min(at - self.base, len(self.buffer))
            self.buffer, self.base = self.buffer[skip:] + self._more(max(1 << 20, n)), self.base + skip
        return self.buffer[at - self.base : at - self.base + n]

    def end(self) -> int:
        """Where the next member starts; the rest of this one is passed over."""
        while not self.zip.eof:
            self._more(1 << 20)
        return self.next - len(self.zip.unused_data)


class _Source:
    """Records of one archive, headers first."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def records(self, wanted, payloads) -> Iterator[dict]:
        if self._at(0, 2) == b"\x1f\x8b":
            yield from self._members(wanted, payloads)
        else:
            yield from self._sequence(self._at, wanted, payloads)

    def _members(self, wanted, payloads) -> Iterator[dict]:
        at = 0
        while at < self.size:
            data = self._at(at, _HEAD)
            if len(data) >= 24 and data[3] & 4 and data[12:16] == b"sl\x08\0":
                length, full = struct.unpack("<II", data[16:24])
                unzip, head, left, done = zlib.decompressobj(31), b"", data[:length], min(len(data), length)
                parsed = None
                while left:
                    # as much again each time, so that long headers are searched a few times only
                    head += unzip.decompress(left, max(_HEAD, len(head)))
                    parsed = parse_head(head)
                    if unzip.eof or _complete(head, parsed):
                        break
                    left = unzip.unconsumed_tail
                    if not left and done < length:
                        left = self._at(at + done, min(max(_HEAD, done), length - done))
                        done += len(left)
                if parsed is None:
                    raise ValueError(f"a record without headers at byte {at}")
                if parsed[1] + int(parsed[0]["content-length"]) + 4 >= full:
                    yield from self._record(*parsed, head, lambda: zlib.decompress(self._at(at, length), 31), wanted, payloads)  # noqa: B023
                    at += length
                    continue
            # several records, or no word of its length
            member = _Unzipped(self._at, at)
            yield from self._sequence(member, wanted, payloads)
            at = member.end()

    def _sequence(self, read: Callable[[int, int], bytes], wanted, payloads) -> Iterator[dict]:
        """Records one after another."""
        at = 0
        while read(at, _HEAD).strip():
            n = _HEAD
            while True:
                data = read(at, n)
                parsed = parse_head(data)
                if _complete(data, parsed) or len(data) < n:
                    break
                n *= 4
            if parsed is None:
                raise ValueError(f"a record without headers at byte {at}")
            head, start = parsed
            length = start + int(head["content-length"])
            yield from self._record(head, start, data, lambda: read(at, length), wanted, payloads)  # noqa: B023
            at += length + 4

    def _record(self, head, start, data, whole, wanted, payloads) -> Iterator[dict]:
        row = columns(head, data[start:])
        if not wanted(row):
            return
        if payloads == "all" or payloads == row["record_type"]:
            block = whole()[start : start + int(head["content-length"])]
            row["payload"] = body_of(head, block)
            told = head.get("warc-payload-digest", "")
            # a payload that was sent in chunks or cut short is not what its digest is of
            plain = "warc-truncated" not in head and b"transfer-encoding:" not in block[: len(block) - len(row["payload"])].lower()
            if row["record_type"] in ("response", "resource") and plain and _SHA1.fullmatch(told) and told != f"sha1:{digest(row['payload'])}":
                raise ValueError(f"the payload of {head.get('warc-record-id')} does not have its digest")
        else:
            row["payload"] = None
        yield row


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.path, self.tests = path, []
        self.payloads = options.get("payload", "all")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if _supported(f):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = _system(self.path)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        out, now, size = [], [], 0
        for name, n in files:
            if now and size + n > self.most:
                out.append(_Files(tuple(now)))
                now, size = [], 0
            now.append(name)
            size += n
        return [*out, _Files(tuple(now))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in _Source(file).records(lambda r: _passes(r, self.tests), self.payloads):
                    rows.append(row)
                    size += 100 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; the files of tasks that counted get their final names on commit."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at = _system(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for b in iterator:
            if out is None:
                system.create_dir(at, recursive=True)
                out = system.open_output_stream(f"{at}/_{name}.writing")
            get = [b.column(b.schema.get_field_index(n)) for n in INPUT]
            for i in range(b.num_rows):
                page, url, kind, refers, known, payload = (c[i].as_py() for c in get)
                payload = payload or b""
                out.write(member(record(page, url, kind, refers, known or digest(payload), payload)))
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{at}/_{m.name}.writing", f"{at}/{m.name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _system(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{at}/_{m.name}.writing")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as records: of equal payloads of ``least_bytes`` or more, the largest page_id's is the response.

    Only (page_id, digest) is shuffled by digest, and joined with the digests of
    several pages; payloads are shuffled once, by page_id, which no group shares.
    A null html is an empty payload, a null url leaves the header out. A null page_id
    is never revisited and never a revisit. Rows with one page_id and equal payloads
    are of one kind. Very long payloads are written and read whole, one at a time in a
    task. Only these three columns are read, whatever others are named. No rows make
    archives of no records.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    light = pages.select("page_id", F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_n")).where(F.col("_n") >= least_bytes)
    several = light.where("page_id IS NOT NULL").groupBy("_sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    several = materialize(several, "payloads")
    again = light.join(several, "_sha1").where("page_id < refers_to").select("page_id", "_sha1", "refers_to").distinct()
    full = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("_sha1"))
    full = full.join(again, ["page_id", "_sha1"], "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return full.select("page_id", "url", kind.alias("record_type"), "refers_to", F.lit(None).cast("string").alias("payload_digest"), "payload")


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Write a record for each page; where."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    with_revisits(pages, least_bytes).write.format("warc").mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: str = "all") -> DataFrame:
    """The records of all archives under ``path``; payload: all, response or none."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)
