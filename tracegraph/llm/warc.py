"""WARC archives as a Spark data source, and the archiving of a table of pages with revisit records.

``spark.read.format("warc").load(path)`` plans one partition per file; a written file ends with the record that brings
it to FILE_BYTES, so that no partition of our own archives is much larger. Filters on record_type, record_id, target_uri,
refers_to and payload_digest are pushed down: a record's headers are parsed first, and the payload of a record that
they rule out (or of all, with option ``payload`` false) is neither inflated nor decoded. Written files are gzip with a
member per record, whose length stands in the member's extra field ``sl``, so that a reader skips to the next one. A
member of 4 GB or more has no such field, and is read through.

Other archives, plain or gzip, are read as well: members may hold several records or parts of one, or be empty, and zeros
may follow them. An archive that ends too soon or holds anything else fails the job.

Null or empty payloads are records of 0 bytes. A null uri has no WARC-Target-URI. Line ends in header values are
percent-coded.
"""

from __future__ import annotations

import contextlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from tracegraph.store import new_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_VERSION = b"WARC/1.1\r\n"
BATCH_BYTES = 8 << 20
#: Bytes after which a written file ends.
FILE_BYTES = 1 << 30
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"


class _Local:
    """Files of a folder that driver and executors mount alike."""

    def list(self, root: str) -> list[str]:
        if os.path.isfile(root):
            return [root]
        return sorted(os.path.join(d, x) for d, _, names in os.walk(root) for x in names)

    def open(self, path: str, mode: str):
        return open(path, mode)

    def make(self, root: str) -> None:
        os.makedirs(root, exist_ok=True)

    def move(self, a: str, b: str) -> None:
        os.replace(a, b)

    def delete(self, path: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(path)


class _Remote(_Local):
    """The same in a store that Arrow has a driver for (hdfs, s3, gs and others)."""

    def __init__(self, store):
        self.store = store

    def list(self, root: str) -> list[str]:
        from pyarrow import fs

        if self.store.get_file_info(root).type == fs.FileType.File:
            return [root]
        return sorted(i.path for i in self.store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File)

    def open(self, path: str, mode: str):
        return self.store.open_input_file(path) if mode == "rb" else self.store.open_output_stream(path)

    def make(self, root: str) -> None:
        self.store.create_dir(root, recursive=True)

    def move(self, a: str, b: str) -> None:
        self.store.move(a, b)

    def delete(self, path: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            self.store.delete_file(path)


def _fs(path: str) -> tuple[_Local, str]:
    if path.startswith("file:"):
        return _Local(), "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        return _Remote(store), root
    return _Local(), path


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field holds its own length and that of its contents."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    head = struct.pack("<4BI2BH", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12)
    total = len(head) + 12 + len(body) + 8
    if max(total, len(raw)) >> 32:
        return struct.pack("<4BI2B", 0x1F, 0x8B, 8, 0, 0, 0, 255) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    return head + b"sl" + struct.pack("<HII", 8, total, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _value(x: str) -> str:
    return x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in x or "\n" in x else x


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, size: int, refers_to: str | None = None) -> bytes:
    """A record; a revisit keeps the HTTP headers and leaves out the payload of ``size`` bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_value(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last and line.strip():
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def _bare(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if name == "payload_digest" else value


class _Plain:
    """Records of an open file: ``headers`` of the next one, then ``take`` and ``skip`` inside its block. A file that ends
    inside a record, or holds anything else between records, is an error."""

    def __init__(self, f):
        self.f, self.buf = f, bytearray()
        f.seek(0, 2)
        self.end = f.tell()
        f.seek(0)

    def _more(self, most: int) -> bool:
        """Adds up to ``most`` bytes to ``buf``; False at the end."""
        got = self.f.read(most)
        self.buf += got
        return bool(got)

    def headers(self) -> bytes | None:
        seen = 0
        while True:
            if not seen:
                self.buf = self.buf.lstrip(b"\r\n")
            if not b"WARC/".startswith(self.buf[:5]):
                raise ValueError("an archive holds something that is not a WARC record")
            at = self.buf.find(b"\r\n\r\n", max(0, seen - 3)) if self.buf else -1
            if at >= 0:
                head = bytes(self.buf[:at])
                del self.buf[: at + 4]
                return head
            seen = len(self.buf)
            if not self._more(8192):
                if self.buf:
                    raise ValueError("an archive ends inside a record's headers")
                return None

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more(n - len(self.buf)):
                raise ValueError("an archive ends inside a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def _pass(self, n: int) -> int:
        """Goes over up to ``n`` bytes that are not in ``buf`` without reading them; how many."""
        if self.f.tell() + n > self.end:
            raise ValueError("an archive ends inside a record")
        self.f.seek(n, 1)
        return n

    def skip(self, n: int) -> None:
        while n:
            here = min(n, len(self.buf))
            del self.buf[:here]
            n -= here
            if n:
                n -= self._pass(n)


class _Gzip(_Plain):
    """The same over gzip members, which may hold one record, several, a part of one or nothing, with zeros between them.
    A member that tells its lengths is left for the next one as soon as nothing in it is wanted any more."""

    def __init__(self, f):
        super().__init__(f)
        self.raw, self.z, self.left, self.next = b"", None, None, None

    def _member(self) -> bool:
        """Begins the next member, if there is one."""
        while True:
            self.raw = self.raw.lstrip(b"\0")
            if len(self.raw) >= 24:
                break
            more = self.f.read(1 << 14)
            if not more:
                break
            self.raw += more
        if not self.raw:
            return False
        head = self.raw[:24]
        if head[:2] != b"\x1f\x8b":
            raise ValueError("an archive holds something that is not a gzip member")
        self.left = self.next = None
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            total, size = struct.unpack("<II", head[16:24])
            if total > len(head):
                self.left, self.next = size, self.f.tell() - len(self.raw) + total
        self.z = zlib.decompressobj(31)
        return True

    def _more(self, most: int) -> bool:
        while True:
            if self.z is None and not self._member():
                return False
            out = self.z.decompress(self.raw, most)
            self.raw = self.z.unconsumed_tail
            if self.left is not None:
                self.left -= len(out)
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, None
            elif not out and not self.raw:
                self.raw = self.f.read(1 << 14)
                if not self.raw:
                    raise ValueError("an archive ends inside a gzip member")
            if out:
                self.buf += out
                return True

    def _pass(self, n: int) -> int:
        if self.z is not None and self.left is not None and self.left <= n + 4:  # the record's last line ends may follow
            gone = max(0, min(n, self.left))
            if self.next > self.end:
                raise ValueError("an archive ends inside a gzip member")
            self.f.seek(self.next)
            self.raw, self.z = b"", None
            return gone
        if not self._more(min(n, 1 << 16)):
            raise ValueError("an archive ends inside a record")
        return 0


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADERS and isinstance(f, (EqualTo, In, IsNotNull, IsNull)):
                self.wanted.append((name, "in" if isinstance(f, (EqualTo, In)) else "null" if isinstance(f, IsNull) else "set", tuple(f.value) if isinstance(f, In) else (getattr(f, "value", None),)))
            else:
                yield f

    def partitions(self):
        store, root = _fs(self.path)
        found = [(x, x.rpartition("/")[2]) for x in store.list(root)]
        return [WarcFile(x) for x, name in found if x == root or (name[0] not in "._" and ".warc" in name)]

    def _fits(self, head: dict[str, str]) -> bool:
        for name, how, values in self.wanted:
            got = _bare(name, head.get(_HEADERS[name]))
            if (got not in values or got is None) if how == "in" else (got is None) != (how == "null"):
                return False
        return True

    def read(self, partition):
        store, _ = _fs(self.path)
        rows, held = [], 0
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        with store.open(partition.path, "rb") as f:
            magic = f.read(2)
            f.seek(0)
            source = _Gzip(f) if magic == b"\x1f\x8b" else _Plain(f)
            while (raw := source.headers()) is not None:
                head = parse_headers(raw)
                if not head.get("content-length", "").isdecimal():
                    raise ValueError("a record has no Content-Length")
                size = int(head["content-length"])
                if not self._fits(head):
                    source.skip(size)
                    continue
                length, payload = size, None
                if "application/http" in head.get("content-type", ""):
                    http = b""
                    while b"\r\n\r\n" not in http and len(http) < size:
                        http += source.take(min(512, size - len(http)))
                    http, found, payload = http.partition(b"\r\n\r\n")
                    if not found:  # no HTTP headers after all
                        http, payload = b"", http
                    length = size - len(http) - len(found)
                    if head.get("warc-type") == "revisit":
                        length, payload = int(parse_headers(http).get("content-length", 0)), None
                    elif self.payload:
                        payload += source.take(length - len(payload))
                    else:
                        source.skip(length - len(payload))
                elif self.payload:
                    payload = source.take(size)
                else:
                    source.skip(size)
                rows.append((*(_bare(n, head.get(_HEADERS[n])) for n in ("record_id", "record_type", "target_uri")), head.get("warc-date"), *(_bare(n, head.get(_HEADERS[n])) for n in ("payload_digest", "refers_to")), length, payload if self.payload else None))
                held += len(payload or b"") + 200
                if held > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under hidden names; the files of the tasks that count are renamed at the end."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches):
        store, root = _fs(self.path)
        store.make(root)
        names, out, size = [], None, 0
        try:
            for b in batches:
                for r in b.to_pylist():
                    if out is None:
                        names.append(f"{root}/.part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open(names[-1], "wb"), 0
                    raw = member(record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload"] or b"", r["payload_bytes"], r["refers_to"]))
                    out.write(raw)
                    size += len(raw)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        store, root = _fs(self.path)
        store.make(root)
        if self.overwrite:
            for x in store.list(root):
                if x.rpartition("/")[2][0] != ".":
                    store.delete(x)
        for path in (x for m in messages if m for x in m.paths):
            folder, _, name = path.rpartition("/")
            store.move(path, f"{folder}/{name[1:]}")

    def abort(self, messages):
        store, _ = _fs(self.path)
        for path in (x for m in messages if m for x in m.paths):
            store.delete(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base 32: 40 bits at a time are eight digits."""
    digest = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest): the html in UTF-8 and its SHA-1 in base 32."""
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    return raw.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a record per row of ``pages`` to ``path``: of equal payloads of ``least_bytes`` or more, that with the least
    page_id is a response and the others revisit it. A page with a null id is a revisit if one with an id has its payload,
    else a response, as nothing can refer to it; rows that repeat an id and its payload are alike.

    Which pages revisit which is worked out on ids and digests alone; payloads move once, to meet their verdicts by id."""
    register(pages.sparkSession)
    found = payloads(pages)
    small = found.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= least_bytes)
    first = small.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    again = small.join(first, ["payload_digest", "payload_bytes"]).where("page_id is null or first_id < page_id")
    again = again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "first_id").distinct()
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    records = found.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").select(
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("urn:uuid:"), F.uuid())).alias("record_id"),
        F.when(F.col("first_id").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        "payload_digest",
        urn(F.col("first_id")).alias("refers_to"),
        "payload_bytes",
        F.when(F.col("first_id").isNull(), F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    path = new_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.when(F.col(c).startswith("urn:page:"), F.substring_index(c, ":", -1).cast("long"))
    return (
        spark.read.format("warc").option("payload", "false").load(path)
        .where(F.col("record_type").isin("response", "revisit"))
        .select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
    )


OP6_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
h as (select page_id, cast(octet_length(encode(html)) as bigint) payload_bytes, sha1(html) h from p),
d as (select page_id, payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 1 + 10 * (i // 8), 10) as bigint) >> (5 * (7 - i % 8))) & 31 as integer), 1)), '') payload_digest from h),
f as (select payload_bytes, payload_digest, min(page_id) first_id from d group by 1, 2)
select page_id, payload_bytes, payload_digest, case when page_id is not null and page_id > first_id or page_id is null and first_id is not null then 'revisit' else 'response' end record_type,
       case when page_id is not null and page_id > first_id or page_id is null then first_id end refers_to
from d join f using (payload_bytes, payload_digest)
"""
