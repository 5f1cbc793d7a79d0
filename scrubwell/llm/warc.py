"""WARC archives as a PySpark Python data source (format ``warc``).

Reading: files are planned as partitions.  Large ones are cut: at record
boundaries where the writer's manifest names them, else a gzip file at the next
member that begins with a WARC record.  Columns are headers by name
(``record_type`` is WARC-Type, ``ip_address`` WARC-IP-Address, ``content_type``
Content-Type, and so on, for any column of the schema that the reader is given),
and besides ``headers`` (all of them), ``payload`` and ``payload_length``.
Predicates on header columns are pushed into the reader (those on
``headers[...]`` are not: Spark doesn't offer them to Python sources), which
parses a record's headers first; if the record isn't wanted, or the schema has no
``payload``, or the option ``payload=false`` is set, its payload is skipped
without being decoded: each written record is a gzip member of its own whose
``sl`` extra field tells its length, so the reader seeks past it.  In plain files
it seeks by Content-Length; other gzip members are read through in pieces.

Writing: each task writes files of its own name and reports them; the commit
writes a manifest, and readers of the folder read what the manifest names.  A
task that is run again leaves at most a file that nobody reads.

Defined results: null payloads are empty; null targets write no target header;
empty tables give an empty archive; repeated rows are separate records; other
columns are ignored.  Foreign records: a header that is missing is null, one that
is repeated is joined by commas; several records in one gzip member are several
records; a record without Content-Length fills the rest of its gzip member, and
is an error in a plain file; digests (``verify``) are checked for MD5, SHA-1,
SHA-256 and SHA-512 in base 32 or 16, others are not.  A damaged record raises an
error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from scrubwell.llm.common import copies, cut

MANIFEST = "manifest.json"
SPLIT_BYTES = 32 << 20
READ_SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
#: Columns whose header has another name than theirs, and headers that don't begin with WARC-.
HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "warc_date": "warc-date"}
PLAIN = ("content-type", "content-length")
NOT_HEADERS = ("headers", "payload", "payload_length")
#: Written so that a revisit, which has no payload, still tells its length.
LENGTH = "WARC-X-Payload-Length"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Local paths and any store that pyarrow knows by its scheme."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if "://" in path or not path.startswith("file:/") else (fs.LocalFileSystem(), path[5:])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose ``sl`` field holds its compressed and its plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, target: str | None, date: str, payload: bytes, digest: str, refers_to: str | None, length: int) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), (LENGTH, str(length))]
    if target is not None:
        head.append(("WARC-Target-URI", target.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int  # -1: to the end of the file
    sought: bool = False  # the first record is the next one that begins after the start


class WarcSource(DataSource):
    """Options: ``path`` (a folder or a file), ``payload`` (true), ``verify`` (false: check digests), ``level`` (gzip)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_type, record_id, target_uri, warc_date, payload_digest, refers_to, payload_length, payload."""

    def __init__(self, options):
        self.path, self.level = options["path"].rstrip("/"), int(options.get("level", "1"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        name, at, marks, last = f"part-{uuid.uuid4().hex}.warc.gz", 0, [], 0
        out = None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                    data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["warc_date"], r["payload"] or b"", r["payload_digest"], r["refers_to"], r["payload_length"]), self.level)
                    if at - last >= SPLIT_BYTES:
                        marks.append(at)
                        last = at
                    out.write(data)
                    at += len(data)
        finally:
            if out:
                out.close()
        return Written([{"name": name, "bytes": at, "marks": marks}] if at else [])

    def commit(self, messages: list) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list) -> None:
        store, root = filesystem(self.path)
        for f in [f for m in messages if m for f in m.files]:
            store.delete_file(f"{root}/{f['name']}")


class Stream:
    """Bytes that come in pieces from ``pull`` (empty at the end); ``seek`` moves forward without reading."""

    def __init__(self, pull: Callable[[], bytes], seek: Callable[[int], None] | None = None):
        self.pull, self.seek, self.rest = pull, seek, bytearray()

    def more(self) -> bool:
        piece = self.pull()
        self.rest += piece
        return bool(piece)

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next ``mark``, which is passed; null if there is none."""
        at = 0
        while (stop := self.rest.find(mark, at)) < 0:
            at = max(0, len(self.rest) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.rest[:stop])
        del self.rest[: stop + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.rest) < n and self.more():
            pass
        out = bytes(self.rest[:n])
        del self.rest[:n]
        return out

    def skip(self, n: int) -> None:
        have = min(n, len(self.rest))
        del self.rest[:have]
        if n > have and self.seek:
            self.seek(n - have)
        while not self.seek and n > have and self.more():
            k = min(n - have, len(self.rest))
            del self.rest[:k]
            have += k

    def blank(self) -> bool:
        """Passes line breaks; whether anything follows."""
        while True:
            rest = self.rest.lstrip(b"\r\n")
            self.rest = bytearray(rest)
            if rest or not self.more():
                return bool(self.rest)


def header_of(column: str) -> str:
    name = column.lower().replace("_", "-")
    return HEADER.get(column.lower()) or (name if name in PLAIN or name.startswith("warc-") else f"warc-{name}")


def right_digest(told: str, payload: bytes) -> bool:
    """Whether ``told`` (algorithm:value) is the payload's digest; algorithms that aren't known pass."""
    kind, _, value = told.partition(":")
    if kind.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(kind.lower().replace("-", ""), payload).digest()
    return value.upper().rstrip("=") in (base64.b32encode(digest).decode().rstrip("="), digest.hex().upper())


class WarcReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"].rstrip("/"), columns
        self.payload = options.get("payload", "true").lower() == "true" and "payload" in columns
        self.verify = options.get("verify", "false").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality, IN, prefix and not-null on header columns; the rest, ``headers[...]`` too, goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 and f.attribute[0] not in NOT_HEADERS else None
            if name and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "some", None))
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return self._cut(info)
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                files = json.loads(f.read())["files"]
            return [Part(f"{root}/{x['name']}", a, b) for x in files for a, b in zip([0, *x["marks"]], [*x["marks"], x["bytes"]], strict=True)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [p for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz")) for p in self._cut(x)]

    def _cut(self, info) -> list[Part]:
        """A foreign gzip file in parts of ``split`` bytes; a plain one is one part, whose payloads are sought past."""
        if not info.path.endswith(".gz"):
            return [Part(info.path, 0, -1)]
        starts = range(0, max(1, info.size), self.split)
        return [Part(info.path, a, min(info.size, a + self.split), a > 0) for a in starts]

    def value(self, head: dict[str, str], column: str) -> str | None:
        got = head.get(header_of(column))
        return got.strip("<>") if got and column in ("record_id", "refers_to") else got

    def wanted(self, head: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            got = self.value(head, column)
            if got is None or kind == "in" and got not in value or kind == "prefix" and not got.startswith(value):
                return False
        return True

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:  # an archive without files has no partition
            return
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.path) as f:
            for head, payload in self._plain(f) if not partition.path.endswith(".gz") else self._members(f, partition):
                digest = head.get("warc-payload-digest")
                if payload is not None and self.verify and digest and not right_digest(digest, payload):
                    raise ValueError(f"{partition.path}: a payload differs from its digest {digest}")
                told = head.get(LENGTH.lower())
                row = {"headers": head, "payload": payload, "payload_length": int(told) if told is not None else len(payload) if payload is not None else None}
                yield tuple(row[c] if c in row else self.value(head, c) for c in self.columns)

    def _plain(self, f) -> Iterator[tuple[dict, bytes | None]]:
        f.seek(0)
        yield from self._records(Stream(lambda: f.read(1 << 16), lambda n: f.seek(f.tell() + n)), False)

    def _members(self, f, partition: Part) -> Iterator[tuple[dict, bytes | None]]:
        """The records of the gzip members that begin in the partition."""
        size = f.size()
        end = size if partition.end < 0 else partition.end
        at = self._sync(f, partition.start, end) if partition.sought else partition.start
        while at < end:
            f.seek(at)
            first = f.read(4096)
            told = _told_lengths(first)
            if told is not None:
                unpack = zlib.decompressobj(31)
                s = Stream(_unpacked(unpack, first, f))
                text = s.until(b"\r\n\r\n")
                if text is None:
                    raise ValueError(f"{partition.path}: a gzip member without WARC headers at {at}")
                head = _headers(text)
                own = head.get("content-length", "")
                if own.isdigit() and (len(text) + 4 + int(own) + 4) & 0xFFFFFFFF == told[1]:  # one record, whose place is known
                    at += told[0]
                    if got := self._record(s, head, True):
                        yield got
                    continue
                f.seek(at + len(first))  # several: read to the member's end
            unpack = zlib.decompressobj(31)
            s = Stream(_unpacked(unpack, first, f))
            yield from self._records(s, True)
            while s.more():
                s.rest.clear()
            at = f.tell() - len(unpack.unused_data)
            if not unpack.eof:
                raise ValueError(f"{partition.path}: a record ends before its gzip member does")

    def _sync(self, f, start: int, end: int) -> int:
        """The first place from ``start`` on where a gzip member with a WARC record begins; ``end`` or later without one."""
        at, window = start, b""
        f.seek(start)
        while at < end:
            window = f.read(1 << 20)
            if not window:
                return end
            k = -1
            while (k := window.find(b"\x1f\x8b\x08", k + 1)) >= 0:
                f.seek(at + k)
                try:
                    if zlib.decompressobj(31).decompress(f.read(4096), 64).lstrip(b"\r\n").startswith(b"WARC/"):
                        return at + k
                except zlib.error:
                    pass
            at += max(1, len(window) - 2)  # a mark may lie across two windows
            f.seek(at)
        return end

    def _records(self, s: Stream, gzipped: bool) -> Iterator[tuple[dict, bytes | None]]:
        while s.blank():
            text = s.until(b"\r\n\r\n")
            if text is None:
                raise ValueError("a record ends within its headers")
            if got := self._record(s, _headers(text), gzipped):
                yield got

    def _record(self, s: Stream, head: dict[str, str], gzipped: bool) -> tuple[dict, bytes | None] | None:
        """Headers and payload (null: not asked for) of the record whose block comes next; null if it isn't wanted."""
        told = head.get("content-length", "")
        if not told.isdigit() and not gzipped:
            raise ValueError("a record without Content-Length in a plain file")
        want = self.wanted(head)
        if not want or not self.payload or head.get("warc-type") == "revisit":
            if told.isdigit():
                s.skip(int(told))
            else:
                while s.more():
                    s.rest.clear()
                s.rest.clear()
            return (head, None) if want else None
        if told.isdigit():
            block = s.take(int(told))
            if len(block) < int(told):
                raise ValueError("a record ends before its Content-Length")
        else:
            while s.more():
                pass
            block = bytes(s.rest).removesuffix(b"\r\n\r\n")
            s.rest.clear()
        # the payload: what follows the HTTP headers of a block that has them
        return head, block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


def _unpacked(unpack, first: bytes, f) -> Callable[[], bytes]:
    """Pieces of the one gzip member that begins with ``first`` and goes on in ``f``."""
    pieces = iter([first])

    def pull() -> bytes:
        while not unpack.eof:
            piece = next(pieces, None) or f.read(1 << 16)
            if not piece:
                raise ValueError("a record ends before its gzip member does")
            if got := unpack.decompress(piece):
                return got
        return b""

    return pull


def _told_lengths(first: bytes) -> tuple[int, int] | None:
    """The compressed and the plain length of a gzip member by its ``sl`` field."""
    if first[:4] == b"\x1f\x8b\x08\x04":
        (xlen,) = struct.unpack_from("<H", first, 10)
        k = 12
        while k + 4 <= min(12 + xlen, len(first)):
            (n,) = struct.unpack_from("<H", first, k + 2)
            if first[k : k + 2] == b"sl" and n == 8:
                return struct.unpack_from("<II", first, k + 4)
            k += 4 + n
    return None


def _headers(block: bytes) -> dict[str, str]:
    """Header values by lower-case name; folded lines are joined, and so are repeated headers, by a comma."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: The alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: each ten of them are eight characters."""
    out = []
    for k in range(4):
        n = F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def records_of(pages: DataFrame, body: str = "html", least_bytes: int = 0, prefix: str = "urn:x-page:") -> DataFrame:
    """A record for each page: of equal payloads of at least ``least_bytes``, the page with the least id is the response, the others revisit it.

    Null ids come last; of pages with the same id and payload one is the response
    (that with the least url), the others revisit it.  Kinds are settled on a
    compact table.  Revisits need no payload; each different payload is shuffled
    once, whatever the number of its pages.
    """
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "utf-8")
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"))
    df = df.withColumn("_sha", F.sha1("payload"))
    own = ["page_id", "target_uri", "_sha", "payload_length"]
    rows = cut(df.select("page_id", "target_uri", "_sha", F.octet_length("payload").cast("long").alias("payload_length")).groupBy(*own).agg(F.count(F.lit(1)).alias("_n")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "target_uri"))
    rows = rows.join(rows.groupBy("_sha").agg(first.alias("_first")), "_sha")
    is_first = F.col("page_id").eqNullSafe(F.col("_first.page_id")) & F.col("target_uri").eqNullSafe(F.col("_first.target_uri"))
    rows = rows.withColumn("_answers", F.when(F.col("payload_length") < least_bytes, F.col("_n")).when(is_first, 1).otherwise(0).cast("long")).withColumn("_again", F.col("_n") - F.col("_answers"))
    refers = F.concat(F.lit(prefix), F.coalesce(F.col("_first.page_id").cast("string"), F.lit("null")))
    revisits = copies(rows.filter("_again > 0").select(*own, refers.alias("refers_to"), "_again"), "_again", "_k").select(*own, "refers_to", F.lit("revisit").alias("record_type"), F.lit(None).cast("binary").alias("payload"))
    payloads = df.select("_sha", "payload").dropDuplicates(["_sha"])
    answers = copies(rows.filter("_answers > 0").select(*own, "_answers"), "_answers", "_k").join(payloads, "_sha").select(*own, F.lit(None).cast("string").alias("refers_to"), F.lit("response").alias("record_type"), "payload")
    return answers.unionByName(revisits).select(
        "record_type",
        F.concat(F.lit(prefix), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        "target_uri",
        F.lit("2000-01-01T00:00:00Z").alias("warc_date"),
        base32_of_hex(F.col("_sha")).alias("payload_digest"),
        "refers_to",
        "payload_length",
        "payload",
    )


def write(pages: DataFrame, path: str, **how) -> None:
    spark = pages.sparkSession
    register(spark)
    records_of(pages, **how).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The records under ``path``; with ``columns``, only those (headers by name; without ``payload`` no payload is decoded)."""
    register(spark)
    reader = spark.read.format("warc").options(**options)
    if columns is not None:
        known = dict(x.split(" ") for x in READ_SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"`{c}` {known.get(c, 'string')}" for c in columns))
    return reader.load(path)
