"""WARC archives as a PySpark Python data source (format ``decidra_warc``).

Writing: every task writes its own files, a gzip member for each record, and rolls over at
``roll_bytes``; each commit lists the files of its successful tasks in a ``_MANIFEST-*.json`` of its own, so
files left by lost or repeated tasks are never read, and writers that append at once lose nothing. Reading: the planner packs files into partitions of about
``partition_bytes``; predicates on record_type, record_id, target_uri, payload_digest and refers_to
are pushed down; a task parses a record's headers first and, if they fail, goes on to the next
record by the member's length (gzip extra field ``sl``) or by Content-Length, without reading or
decoding the payload. Files are opened by pyarrow's filesystems, so any URI that those know works.

A file is read by one task: a payload may itself hold bytes that look like the start of a record or member,
so a place in the middle of a file can't be told for sure. Write files of about ``roll_bytes``. Damaged
archives (a member or record that ends too early, a line that is no header) raise an error, naming the place.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import cut, utf8

MANIFEST = "_MANIFEST-"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, headers map<string, string>, payload binary"
#: Column and the header that holds it.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
#: Most digests that are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


# --- records as bytes


def _header_value(value: str) -> str:
    """Line breaks and other controls can't stand in a header; they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_bytes(record_id, record_type, target_uri, payload, payload_digest, payload_length, refers_to) -> bytes:
    block = HTTP_HEAD + payload if payload is not None else b""
    headers = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Target-URI", target_uri), ("WARC-Date", "1970-01-01T00:00:00Z")]
    headers += [("WARC-Payload-Digest", payload_digest and f"sha256:{payload_digest}"), ("X-Payload-Length", payload_length), ("WARC-Refers-To", refers_to)]
    headers += [("WARC-Profile", REVISIT_PROFILE if record_type == "revisit" else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {_header_value(str(v))}\r\n" for k, v in headers if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field sl holds the lengths of the member and of the data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Headers(dict):
    """Header values by name as written; names are looked up whatever their case."""

    def get(self, name, default=None):
        if name in self:
            return self[name]
        low = name.lower()
        return next((v for k, v in self.items() if k.lower() == low), default)


def parse_headers(head: bytes) -> Headers:
    """Values of a repeated name are joined by ", "; a line that begins with white space goes on with the last value."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out, names, last = Headers(), {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            last = names.setdefault(name.lower(), name)
            out[last] = f"{out[last]}, {value}" if last in out else value
    return out


class _Bytes:
    """The bytes of a file from a place on, through all gzip members if it is compressed."""

    STEP = 1 << 17

    def __init__(self, file, size: int, packed: bool) -> None:
        self.file, self.size, self.packed = file, size, packed
        self.go(0)

    def go(self, at: int) -> None:
        """Start at a byte of the file; in a compressed one, the first of a member."""
        self.file.seek(at)
        self.member, self.held, self.raw = at, bytearray(), b""
        self.unpack = zlib.decompressobj(31) if self.packed else None
        self.known, self.fed = None, False
        self.step = 8192  # a header's worth; more once a payload is read

    def _more(self) -> bool:
        raw = self.raw or self.file.read(self.step)
        self.raw = b""
        if not self.packed:
            self.held += raw
            return bool(raw)
        if not raw:
            if self.fed and not self.unpack.eof:
                raise ValueError(f"the gzip member at {self.member} is cut off")
            return False
        if self.unpack.eof:
            self.unpack = zlib.decompressobj(31)
        elif self.known is None and self.file.tell() - len(raw) == self.member:
            self.known = struct.unpack_from("<II", raw, 16) if len(raw) >= 24 and raw[3] == 4 and raw[12:14] == b"sl" else (0, 0)
        self.fed = True
        try:
            self.held += self.unpack.decompress(raw)
        except zlib.error as e:
            raise ValueError(f"the gzip member at or after {self.member} is damaged: {e}") from e
        if self.unpack.eof:
            self.raw = self.unpack.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is passed; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise ValueError(f"the record at {self.member} is cut off")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes, or None if they needn't be kept."""
        self.step = self.STEP
        out = bytearray()
        while n > 0:
            if not self.packed and not keep and n > len(self.held):
                n -= len(self.held)
                self.held.clear()
                if self.file.tell() + n > self.size:
                    raise ValueError(f"a record ends behind the file, at {self.file.tell() + n}")
                self.file.seek(n, 1)
                break
            if not self.held and not self._more():
                raise ValueError(f"the record at {self.member} is cut off")
            part = self.held[:n]
            del self.held[:n]
            n -= len(part)
            if keep:
                out += part
        self.step = 8192
        return bytes(out) if keep else None


def read_file(fs: pafs.FileSystem, path: str, wanted=lambda headers: True, with_payload: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, block) of the wanted records of one file; block is None if payloads aren't wanted.

    A member may hold several records. If its extra field shows that one record fills it, an unwanted payload is
    passed by seeking, else by reading on. A file that ends within a record or a member is an error."""
    with fs.open_input_file(path) as file:
        size = file.size()
        source = _Bytes(file, size, file.read(2) == b"\x1f\x8b")
        fresh = True  # at the first byte of a member
        while True:
            head = source.until(b"\r\n\r\n")
            if head is None:
                return
            headers = parse_headers(head.lstrip(b"\r\n"))
            length = int(headers.get("Content-Length", 0))
            take = wanted(headers)
            keep = take and with_payload
            packed, unpacked = source.known or (0, 0)
            whole = packed and unpacked == (len(head) + 4 + length + 4) & 0xFFFFFFFF
            if fresh and whole and not keep:
                if take:
                    yield headers, None
                if source.member + packed > size:
                    raise ValueError(f"the gzip member at {source.member} is cut off")
                source.go(source.member + packed)
                continue
            block = source.take(length, keep)
            if take:
                yield headers, block
            source.take(4, False)
            fresh = bool(fresh and whole)
            if fresh:
                source.go(source.member + packed)


def payload_of(headers: dict[str, str], block: bytes | None) -> bytes | None:
    if block is None or headers.get("WARC-Type") == "revisit":
        return None
    if headers.get("Content-Type", "").lower().startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        return block[end + 4 :] if end >= 0 else b""
    return block


# --- data source


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Files(InputPartition):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll_bytes: int, overwrite: bool) -> None:
        self.path, self.roll_bytes, self.overwrite = path, roll_bytes, overwrite

    def write(self, iterator):
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("record_id", "record_type", "target_uri", "payload", "payload_digest", "payload_length", "refers_to")]
                for row in zip(*columns, strict=True):
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    member = gzip_member(record_bytes(*(x.as_py() for x in row)))
                    out.write(member)
                    size += len(member)
                    if size >= self.roll_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        """Every commit adds a manifest of its own, which appears whole by a rename; overwriting drops older ones after that."""
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        old = _manifests(fs, folder) if self.overwrite else []
        name = f"{MANIFEST}{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{folder}/.{name}.new", compression=None) as out:
            out.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())
        fs.move(f"{folder}/.{name}.new", f"{folder}/{name}.json")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages):
        fs, folder = open_fs(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f"{folder}/{f}")


def _manifests(fs, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and re.fullmatch(rf"{MANIFEST}\w+\.json", x.base_name))


def _manifest(fs, folder: str) -> list[str] | None:
    """The files of all commits; None for a folder that this source has not written."""
    paths = _manifests(fs, folder)
    names = []
    for path in paths:
        with fs.open_input_stream(path, compression=None) as f:
            names += json.loads(f.read())
    return names if paths else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.allowed: dict[str, set] = {}
        if "record_types" in options:
            self.allowed["record_type"] = set(options["record_types"].split(","))

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed.get(name, values) & values
            elif not (name == "record_type" and isinstance(f, IsNotNull)):
                yield f

    def partitions(self):
        fs, folder = open_fs(self.path)
        names = _manifest(fs, folder)
        if names is None:
            found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
            infos = [x for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)]
        else:
            infos = fs.get_file_info([f"{folder}/{n}" for n in names])
        parts, size = [], 0
        for x in sorted(infos, key=lambda x: x.path):
            if not parts or size + x.size > self.partition_bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append(x.path)
            size += x.size
        return parts or [Files([])]

    def _wanted(self, headers: dict) -> bool:
        return all(column(headers, name) in values for name, values in self.allowed.items())

    def read(self, partition):
        fs, _ = open_fs(self.path)
        kind = pa.schema([(c, pa.string()) for c in FIELDS] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to", "headers", "payload"]
        kind = pa.schema([kind.field(n) for n in names])
        rows, held = [], 0
        for path in partition.files:
            for headers, block in read_file(fs, path, self._wanted, self.with_payload):
                payload = payload_of(headers, block)
                length = len(payload) if payload is not None else headers.get("X-Payload-Length")
                rows.append({n: column(headers, n) for n in FIELDS} | {"payload_length": int(length) if length is not None else None, "headers": list(headers.items()), "payload": payload})
                held += len(payload or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


def column(headers: dict, name: str) -> str | None:
    value = headers.get(FIELDS[name])
    return value.removeprefix("sha256:") if value and name == "payload_digest" else value


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "decidra_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", 64 << 20)), overwrite)


# --- operator


def page_records(pages: DataFrame) -> DataFrame:
    """The WARC records of pages: a response each, or a revisit of the smallest page_id with the same payload.

    Payloads under MIN_REVISIT_BYTES are always responses, and so is every row that has the smallest
    id itself (repeated rows). Null html is an empty payload. Null ids are never referred to unless
    all ids of the payload are null; then all its rows are responses. Only digests that occur more
    than once meet the pages again, by broadcast if at most BROADCAST_DIGESTS, else by a shuffle.
    A record's id is its page id and the start of its digest: rows that share one are the same page with the
    same payload. Ids are of any plain type. An empty table gives no records; other columns are ignored.
    """
    body = pages.select(F.col("page_id"), F.col("url"), utf8(F.col("html")).alias("payload"))
    body = body.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    large = body.where(F.col("n_bytes") >= MIN_REVISIT_BYTES).select("digest", "page_id")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = cut(groups.where((F.col("n") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id"))
    small = firsts.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    joined = body.join(F.broadcast(firsts) if small else firsts, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    spelled = lambda c: F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit(""))
    name = lambda c: F.concat(F.lit("<urn:page:"), spelled(c), F.lit("/"), F.substring("digest", 1, 16), F.lit(">"))
    return joined.select(
        name("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("digest").alias("payload_digest"),
        F.col("n_bytes").alias("payload_length"),
        F.when(revisit, name("first_id")).alias("refers_to"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("decidra_warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records below path. Options: record_types, payload (false: headers only), partition_bytes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("decidra_warc").options(**options).load(path)


def page_of(name: str):
    """The page id in a record id, as a string; null if there is none."""
    return F.nullif(F.url_decode(F.regexp_extract(name, r"^<urn:page:([^/>]*)(?:/\w*)?>$", 1)), F.lit(""))
