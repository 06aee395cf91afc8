"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing makes one ``.warc.gz`` per task, each record a gzip member of its own whose extra field "sl"
holds the member's compressed and plain length. Every write commits a manifest of its finished files, so
files of lost or repeated attempts are never read; reading takes the files of all manifests, and an overwrite removes
the manifests and files that were there before. Reading plans partitions of whole files
of about ``partition_bytes``; in each member only the first bytes are inflated until the headers are
complete, record-type and header predicates (pushed down by Spark or given as options) are tested,
and the payload of an unwanted record is skipped by its length without being inflated. Files
without "sl" fields and plain ``.warc`` files are read too. Files are opened through
``pyarrow.fs``, so that any store with a URI that it knows will do.

Defined cases: a null payload is empty; a null url is an empty target; a page with a null id is
always a response; equal payloads with the same largest id are all responses; an empty table
writes an archive without records; records whose headers are malformed raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from corpuslens.llm.tables import table
from corpuslens.plans.scratch import Scratch

_MANIFEST = re.compile(r"_files-[0-9a-f]{32}\.json")
SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, content_type string, content_length long, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, path string, offset long"
)
_ARROW = pa.schema(
    [
        (n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
        for n, t in (x.split(" ") for x in SCHEMA.split(", "))
    ]
)
#: Output column -> WARC header that it shows; these can be tested before any payload is inflated.
HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "content_type": "content-type",
    "content_length": "content-length",
    "refers_to": "warc-refers-to",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD_BYTES = 2048
_LENGTH_LIMIT = 0xFFFFFFFF


def _open_fs(path: str):
    from pyarrow import fs

    if "://" not in path:
        return (fs.FileSystem.from_uri("file://" + path) if path.startswith("/") else fs.FileSystem.from_uri("file:///" + path.removeprefix("file:").lstrip("/")))
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- members ---------------------------------------------------------------------------------


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member with its compressed and plain lengths in the extra field "sl"."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    lengths = min(total, _LENGTH_LIMIT).to_bytes(4, "little") + min(len(data), _LENGTH_LIMIT).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + lengths
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & _LENGTH_LIMIT).to_bytes(4, "little")


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id, url: str, payload: bytes, record_type: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = "".join(url.split("\r")).replace("\n", "%0A")
    headers = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
    ]
    if record_type == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return record_bytes(headers, http)
    return record_bytes(headers, http + payload)


@dataclass
class Member:
    """One record as it is read: headers first, the block only on demand."""

    headers: dict[str, str]
    offset: int
    _head: bytes
    _rest: object

    def block(self) -> bytes:
        length = int(self.headers.get("content-length", 0))
        return self._rest(self._head, length)


def _parse_headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.decode("utf-8", "replace").strip()
        elif b":" in line:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            last = key.strip().lower()
            out[last] = value.strip()
        elif line:
            raise ValueError("malformed WARC header")
    return out


def _gzip_header(f) -> tuple[int, int] | None:
    """(header bytes, member bytes or 0 if unknown) of the member at hand; None at the end of the file."""
    head = f.read(10)
    if len(head) < 10:
        return None
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    size, total, flags = 10, 0, head[3]
    if flags & 4:
        n = int.from_bytes(f.read(2), "little")
        extra, at = f.read(n), 0
        size += 2 + n
        while at + 4 <= n:
            length = int.from_bytes(extra[at + 2 : at + 4], "little")
            if extra[at : at + 2] == b"sl" and length >= 8:
                total = int.from_bytes(extra[at + 4 : at + 8], "little")
            at += 4 + length
    for flag in (8, 16):
        if flags & flag:
            while (c := f.read(1)) and c != b"\0":
                size += 1
            size += 1
    if flags & 2:
        f.read(2)
        size += 2
    return size, 0 if total == _LENGTH_LIMIT else total


def gzip_records(f) -> Iterator[Member]:
    offset = 0
    while True:
        f.seek(offset)
        found = _gzip_header(f)
        if found is None:
            return
        size, total = found
        inflate, head = zlib.decompressobj(-15), b""
        while b"\r\n\r\n" not in head and not inflate.eof:
            piece = f.read(_HEAD_BYTES)
            if not piece:
                raise ValueError("truncated gzip member")
            head += inflate.decompress(piece)
        cut = head.index(b"\r\n\r\n") + 4

        def rest(start: bytes, length: int, inflate=inflate) -> bytes:
            out = [start]
            while not inflate.eof and (piece := f.read(1 << 16)):
                out.append(inflate.decompress(piece))
            return b"".join(out)[:length]

        member = Member(_parse_headers(head[: cut - 4]), offset, head[cut:], rest)
        yield member
        if total:
            offset += total
        else:
            while not inflate.eof:
                piece = f.read(1 << 16)
                if not piece:
                    return
                inflate.decompress(piece)
            offset = f.tell() - len(inflate.unused_data) + 8


def plain_records(f) -> Iterator[Member]:
    offset = 0
    while True:
        f.seek(offset)
        head = b""
        while b"\r\n\r\n" not in head:
            piece = f.read(_HEAD_BYTES)
            if not piece:
                if head.strip():
                    raise ValueError("truncated WARC record")
                return
            head += piece
        cut = head.index(b"\r\n\r\n") + 4
        headers, start = _parse_headers(head[: cut - 4]), offset + cut

        def rest(_: bytes, length: int, start=start) -> bytes:
            f.seek(start)
            return f.read(length)

        yield Member(headers, offset, b"", rest)
        offset = start + int(headers.get("content-length", 0)) + 4


# -- predicates ------------------------------------------------------------------------------


def _test(value, predicate: tuple) -> bool:
    op, wanted = predicate
    if op == "notnull":
        return value is not None
    if value is None:
        return False
    return {
        "eq": lambda: value == wanted,
        "in": lambda: value in wanted,
        "starts": lambda: value.startswith(wanted),
        "ends": lambda: value.endswith(wanted),
        "contains": lambda: wanted in value,
        "lt": lambda: value < wanted,
        "le": lambda: value <= wanted,
        "gt": lambda: value > wanted,
        "ge": lambda: value >= wanted,
    }[op]()


_PUSHED = {
    EqualTo: "eq",
    In: "in",
    StringStartsWith: "starts",
    StringEndsWith: "ends",
    StringContains: "contains",
    LessThan: "lt",
    LessThanOrEqual: "le",
    GreaterThan: "gt",
    GreaterThanOrEqual: "ge",
}


def _urn(value: str | None) -> str | None:
    return value.removeprefix("<").removesuffix(">") if value is not None else None


def _shown(headers: dict[str, str], column: str):
    value = headers.get(HEADER_COLUMNS[column])
    if column == "content_length":
        return int(value) if value is not None else None
    return _urn(value) if column in ("record_id", "refers_to") else value


# -- data source -----------------------------------------------------------------------------


def _manifests(fs, root: str) -> list[str]:
    """Paths of the manifests directly under root."""
    from pyarrow import fs as afs

    listed = fs.get_file_info(afs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in listed if i.type == afs.FileType.File and _MANIFEST.fullmatch(i.base_name))


def _listed(fs, manifest: str) -> list[tuple[str, int]]:
    """(name, size) of the files of one manifest."""
    with fs.open_input_stream(manifest) as f:
        return [(n, s) for n, s in json.loads(f.read())]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int = 0


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes")  # bytes, digest or none
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.predicates: list[tuple[str, tuple]] = []
        if types := options.get("record_types"):
            self.predicates.append(("record_type", ("in", tuple(t.strip() for t in types.split(",")))))
        self.headers = [(k.partition(".")[2].lower(), v) for k, v in dict(options).items() if k.lower().startswith("header.")]

    def pushFilters(self, filters):
        for f in filters:
            path = getattr(f, "attribute", ())
            column = path[0] if len(path) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.predicates.append((column, ("notnull", None)))
            elif column in HEADER_COLUMNS and type(f) in _PUSHED:
                self.predicates.append((column, (_PUSHED[type(f)], f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as afs

        fs, root = _open_fs(self.path)
        info = fs.get_file_info(root)
        if info.type == afs.FileType.File:
            found = [(root, info.size)]
        else:
            manifests = _manifests(fs, root)
            found = [(f"{root}/{n}", s) for m in manifests for n, s in _listed(fs, m)]
            if not manifests:
                listed = fs.get_file_info(afs.FileSelector(root, recursive=True))
                found = [(i.path, i.size) for i in listed if i.type == afs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        parts: list[Files] = []
        room = 0
        for path, size in sorted(found, key=lambda x: (-x[1], x[0])):
            if not parts or size > room:
                parts.append(Files([]))
                room = self.partition_bytes
            parts[-1].paths.append(path)
            room -= size
        return parts or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(_test(_shown(headers, c), p) for c, p in self.predicates) and all(headers.get(k) == v for k, v in self.headers)

    def _row(self, m: Member, path: str) -> tuple:
        h = m.headers
        digest, size, payload = (h.get("warc-payload-digest") or "").rpartition(":")[2] or None, None, None
        if self.payload != "none":
            block = m.block()
            if (h.get("content-type") or "").startswith("application/http"):
                head, _, body = block.partition(b"\r\n\r\n")
                if h.get("warc-type") == "revisit":
                    sizes = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    size = int(sizes[0]) if sizes else None
                else:
                    size, digest, payload = len(body), base32_sha1(body), body
            else:
                size, digest, payload = len(block), base32_sha1(block), block
            if self.payload == "digest":
                payload = None
        return (*(_shown(h, c) for c in HEADER_COLUMNS), digest, size, payload, path, m.offset)

    def read(self, partition):
        fs, _ = _open_fs(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with io.BufferedReader(_Raw(fs.open_input_file(path)), 1 << 20) as f:
                for m in gzip_records(f) if path.endswith(".gz") else plain_records(f):
                    if self._wanted(m.headers):
                        rows.append(self._row(m, path))
                        held += 500 + len(rows[-1][9] or b"")
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)


class _Raw(io.RawIOBase):
    """A random-access pyarrow file as a raw Python stream."""

    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        return self.f.seek(offset, whence)

    def tell(self):
        return self.f.tell()

    def readinto(self, buffer):
        data = self.f.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self):
        self.f.close()
        super().close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Rows of page_id, url, html, record_type, refers_to; one archive per task."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 4)), overwrite

    def write(self, iterator):
        fs, root = _open_fs(self.path)
        name, size, out = None, 0, None
        try:
            for batch in iterator:
                for r in batch.select(["page_id", "url", "html", "record_type", "refers_to"]).to_pylist():
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        size += out.write(gzip_member(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), self.level))
                    size += out.write(gzip_member(page_record(r["page_id"], r["url"] or "", (r["html"] or "").encode(), r["record_type"], r["refers_to"]), self.level))
        finally:
            if out is not None:
                out.close()
        return Written(name, size)

    def commit(self, messages):
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        old = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([[m.name, m.size] for m in messages if m and m.name]).encode())
        for manifest in old:
            names = [n for n, _ in _listed(fs, manifest)]
            fs.delete_file(manifest)
            self._delete(fs, root, names)

    def abort(self, messages):
        self._delete(*_open_fs(self.path), [m.name for m in messages if m and m.name])

    @staticmethod
    def _delete(fs, root: str, names: list[str]) -> None:
        from pyarrow import fs as afs

        for name in names:
            if fs.get_file_info(f"{root}/{name}").type == afs.FileType.File:
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed to Python sources (a setting that stays on)."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- pages -----------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, record_type, refers_to: of equal payloads of at least min_bytes, only the largest page_id is a response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("__d", F.sha1(F.col("html").cast("binary")))
    owners = scratch.save(rows.groupBy("__d").agg(F.max("page_id").alias("__owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "owners")
    joined = rows.join(owners.withColumnRenamed("__d", "__o"), F.col("__d") == F.col("__o"), "left")
    revisit = (F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("__owner"))
    return joined.select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__owner")).alias("refers_to")
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    scratch = Scratch(spark, "warc")
    archive = scratch.path("archive")
    mark_revisits(table(spark, sf_dir, "pages"), scratch).write.format("warc").mode("append").save(archive)
    records = spark.read.format("warc").option("payload", "digest").option("partition_bytes", 16 << 20).load(archive)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        number(F.col("record_id")).try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to")).try_cast("long")).alias("refers_to"),
    )


#: Base32 of the digest's 160 bits, five at a time.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, max(page_id) AS owner,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(h, CAST(1 + (i // 8) * 10 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER), 1)), 'string_agg', '') AS digest
  FROM p GROUP BY h)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN d USING (h)
"""
