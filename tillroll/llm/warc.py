"""WARC archives as a PySpark data source ("warc"): reader and writer.

Reading.  The driver plans byte ranges of files; a range owns the records that
begin in it.  Filters on record type, address, digest and other header columns
are pushed down: of every record only the header block is inflated first, and
one that no pushed filter wants is stepped over without decoding its payload.
Each record is a gzip member of its own; where the member says how long it is
(the extra field "sl" of the WARC specification) stepping over is a jump.
Plain files work too, by Content-Length, as one partition each.  The option
``payload=false`` leaves all payloads undecoded (null).

Writing.  Each task writes one file under a name of its own attempt; the list
of files is written when all tasks have succeeded, and readers of a folder with
such a list see those files only, so lost or repeated attempts leave no trace.
Nothing but names and counts passes through the driver.

Payloads equal by SHA-1 are stored once: the page with the largest id is the
response, the others are revisits that name it and carry the HTTP header alone.

Defined results: a null payload is an empty one; rows with equal id and equal
payload are all responses if theirs is the largest id, else all revisits; a null
id counts as smallest; a folder without records reads as no rows; a broken
record raises with file and offset.
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
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from ..session import scratch_path
from .blocks import need, small_batches

READ_SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, content_type string, payload_digest string, "
               "refers_to string, http_status int, payload_length bigint, payload binary, headers map<string,string>, file string, offset bigint")
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to", "payload_length", "payload")
#: Header field behind each column that filters may be pushed for.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
             "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
MANIFEST = "_records.json"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_MEMBER = b"\x1f\x8b\x08"
_CHUNK = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str):
    """(file system, path in it) of any address that Arrow knows; a plain path is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


# ---- one record ----

def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field holds its own and its content's length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = _MEMBER + struct.pack("<BIBBH2sHII", 4, 0, 0, 255, 12, b"sl", 8, (24 + len(body) + 8) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    """A response with its HTTP header and payload, or a revisit with the HTTP header alone."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    clean = lambda v: None if v is None else re.sub(r"[\r\n]+", " ", v)
    fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<{clean(row['record_id'])}>", "WARC-Date": row["warc_date"],
              "WARC-Target-URI": clean(row["target_uri"]), "Content-Type": "application/http;msgtype=response",
              "WARC-Payload-Digest": row["payload_digest"] and f"sha1:{row['payload_digest']}",
              "WARC-Profile": REVISIT_PROFILE if revisit else None, "WARC-Refers-To": row["refers_to"] and f"<{clean(row['refers_to'])}>"}
    return record(fields, http if revisit else http + payload)


def parse_fields(block: bytes) -> dict[str, str]:
    """Named fields after the first line, names in lower case; folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def column_value(column: str, fields: dict[str, str]) -> str | None:
    value = fields.get(HEADER_OF[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


def wanted(fields: dict[str, str], filters: list[tuple[str, str, tuple]]) -> bool:
    for column, kind, values in filters:
        value = column_value(column, fields)
        if value is None or kind == "in" and value not in values or kind == "prefix" and not value.startswith(values[0]):
            return False
    return True


class Member:
    """A gzip member that is inflated only as far as asked."""

    def __init__(self, stream, offset: int):
        self.stream, self.offset = stream, offset
        stream.seek(offset)
        self.raw = stream.read(_CHUNK)
        self.length = None
        if self.raw[:3] == _MEMBER and len(self.raw) >= 24 and self.raw[3] & 4 and self.raw[12:14] == b"sl":
            self.length = struct.unpack("<I", self.raw[16:20])[0] or None
        self.inflater = zlib.decompressobj(31)
        self.fed, self.out = 0, bytearray()

    def _more(self, most: int) -> bool:
        if self.inflater.eof:
            return False
        data = self.inflater.unconsumed_tail
        if not data:
            data = self.raw if self.raw else self.stream.read(_CHUNK)
            self.raw = b""
            self.fed += len(data)
            if not data:
                raise EOFError(f"the member at {self.offset} ends early")
        self.out += self.inflater.decompress(data, most)
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """Index just after ``mark``, or -1 if the member ends without it."""
        while (at := self.out.find(mark, start)) < 0:
            if not self._more(4096):
                return -1
        return at + len(mark)

    def upto(self, n: int) -> bytearray:
        while len(self.out) < n and self._more(max(4096, n - len(self.out))):
            pass
        return self.out

    def end(self) -> int:
        """Offset of what follows the member; known without inflating where the member says its length."""
        if self.length:
            return self.offset + self.length
        while self._more(1 << 20):
            self.out.clear()
        return self.offset + self.fed - len(self.inflater.unused_data)


class Plain:
    """An uncompressed record."""

    def __init__(self, stream, offset: int):
        self.stream, self.offset, self.out = stream, offset, bytearray()
        stream.seek(offset)

    def until(self, mark: bytes, start: int = 0) -> int:
        while (at := self.out.find(mark, start)) < 0:
            data = self.stream.read(4096)
            if not data:
                return -1
            self.out += data
        return at + len(mark)

    def upto(self, n: int) -> bytearray:
        while len(self.out) < n:
            data = self.stream.read(n - len(self.out))
            if not data:
                raise EOFError(f"the record at {self.offset} ends early")
            self.out += data
        return self.out


#: Longest run of a payload's bytes that can stand unchanged in a gzip member: one stored block.
_STORED = 65_535


def confirmed(stream, at: int, size: int) -> bool:
    """Whether the member at ``at`` is a record of this file and not of an archive that lies, uncompressed, in a payload.

    Members are followed, by their lengths where they say them.  Inside a
    payload they could only go on to the end of one stored block, so a chain
    that reaches another record after more than that, or the file's end, is
    the file's own.
    """
    first = at
    try:
        while at < size:
            item = Member(stream, at)
            if bytes(item.upto(5)[:5]) != b"WARC/":
                return False
            if at - first > _STORED:
                return True
            at = item.end()
    except (zlib.error, EOFError, ValueError):
        return at > first and padding(stream, at, size)
    return at == size


def padding(stream, at: int, size: int) -> bool:
    """Whether only zeros (a buffer's rest) follow up to the file's end."""
    if size - at > _CHUNK:
        return False
    stream.seek(at)
    return not stream.read(size - at).strip(b"\0")


def next_member(stream, at: int, size: int) -> int:
    """Offset of the first record that begins at or after ``at`` in a file of gzip members, or ``size``."""
    while at < size:
        stream.seek(at)
        data = stream.read(_CHUNK)
        i = data.find(_MEMBER)
        while 0 <= i:
            if confirmed(stream, at + i, size):
                return at + i
            i = data.find(_MEMBER, i + 1)
        at += max(1, len(data) - 2)
        if len(data) < 3:
            return size
    return size


def records(stream, size: int, start: int, end: int, filters: list, decode: bool) -> Iterator[dict]:
    """Rows of the records that begin in [start, end)."""
    stream.seek(0)
    packed = stream.read(2) == _MEMBER[:2]
    at = next_member(stream, start, size) if packed and start else start
    while at < min(end, size):
        if packed and size - at <= _CHUNK and padding(stream, at, size):
            return
        item = Member(stream, at) if packed else Plain(stream, at)
        head = item.until(b"\r\n\r\n")
        if head < 0:
            if not bytes(item.out).strip():
                return
            raise ValueError("a record without the end of its header")
        fields = parse_fields(bytes(item.out[:head]).lstrip(b"\r\n"))
        length = int(fields["content-length"])
        if wanted(fields, filters):
            yield row_of(item, fields, head, length, at, decode)
        at = item.end() if packed else at + head + length + 4


def row_of(item, fields: dict[str, str], head: int, length: int, at: int, decode: bool) -> dict:
    row = {c: column_value(c, fields) for c in HEADER_OF} | {"headers": list(fields.items()), "offset": at, "http_status": None}
    start, stop = head, head + length
    declared = None
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        start = item.until(b"\r\n\r\n", head)
        if 0 <= start <= stop:
            http = bytes(item.out[head:start])
            status = re.match(rb"HTTP/\S+ (\d{3})", http)
            row["http_status"] = int(status[1]) if status else None
            declared = parse_fields(http).get("content-length")
        else:
            start = head
    if fields.get("warc-type") == "revisit":
        known = declared if declared and declared.isdigit() else None
        return row | {"payload": None, "payload_length": int(known) if known else None}
    return row | {"payload": bytes(item.upto(stop)[start:stop]) if decode else None, "payload_length": stop - start}


# ---- data source ----

@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.filters: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.filters.append((column, "in", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In) and None not in f.value:
                self.filters.append((column, "in", tuple(f.value)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.filters.append((column, "prefix", (f.value,)))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.filters.append((column, "there", ()))
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = file_system(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            files = [(root, info.size)]
        elif info.type == fs.FileType.Directory:
            listed = store.get_file_info(f"{root}/{MANIFEST}")
            if listed.type == fs.FileType.File:
                with store.open_input_file(listed.path) as f:
                    files = [(f"{root}/{x['name']}", x["size"]) for x in json.loads(f.read())]
            else:
                files = [(x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True))
                         if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
        else:
            raise FileNotFoundError(self.path)
        # a plain file has no marks that its payloads can't hold, so it is read by one task
        parts = [Range(p, a, min(a + step, n), n) for p, n in sorted(files) if n
                 for step in [self.split if p.endswith(".gz") else n] for a in range(0, n, step)]
        return parts or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, _ = file_system(self.path)
        names = [x.split()[0] for x in re.split(r",\s*(?![^<]*>)", READ_SCHEMA)]
        held, size = [], 0
        with store.open_input_file(partition.path) as stream:
            source = records(stream, partition.size, partition.start, partition.end, self.filters, self.decode)
            while True:
                try:
                    row = next(source, None)
                except Exception as e:
                    raise ValueError(f"{partition.path}, from {partition.start}: {e}") from e
                if row is None:
                    break
                held.append(row | {"file": partition.path})
                size += 300 + len(row["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield _batch(held, names)
                    held, size = [], 0
        if held:
            yield _batch(held, names)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"http_status": pa.int32(), "payload_length": pa.int64(), "payload": pa.binary(), "offset": pa.int64(),
             "headers": pa.map_(pa.string(), pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path = options["path"]
        missing = [c for c in WRITE_COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        store, root = file_system(self.path)
        if not overwrite and store.get_file_info(f"{root}/{MANIFEST}").is_file:
            raise ValueError(f"{self.path} holds records already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        name = f"records-{uuid.uuid4().hex}.warc.gz"
        count = size = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.select(list(WRITE_COLUMNS)).to_pylist():
                    data = member(page_record(row))
                    out.write(data)
                    count, size = count + 1, size + len(data)
        return Written(name, count, size)

    def commit(self, messages: list[Written]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([{"name": m.name, "records": m.records, "size": m.size} for m in messages if m]).encode())

    def abort(self, messages: list[Written]) -> None:
        """Files of a failed job stay unlisted, so no reader sees them."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to a session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages ----

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hexadecimal: Column) -> Column:
    """Base32 of a digest of 160 bits given in hexadecimal: 8 times 20 bits, 4 characters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    def four(i: Column) -> Column:
        bits = F.conv(F.substring(hexadecimal, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(letters, F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def page_records(pages: DataFrame, key: str = "page_id", address: str = "url", html: str = "html", least_bytes: int = 0,
                 date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The rows to write: of equal payloads of at least ``least_bytes`` the largest id is response, the others revisit it."""
    need(pages, key, address, html)
    own = pages.select(F.col(key).cast("bigint").alias("id"), F.col(address).alias("target_uri"),
                       F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    # only digests found more than once travel; counting and the largest id are partial sums
    shared = (own.where(F.octet_length("payload") >= least_bytes).groupBy("sha1")
              .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where("n > 1 AND keeper IS NOT NULL")
              .select(F.col("sha1").alias("shared_sha1"), "keeper"))
    joined = own.join(shared, F.col("sha1") == F.col("shared_sha1"), "left")
    again = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        name(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit(date).alias("warc_date"), base32(F.col("sha1")).alias("payload_digest"), F.when(again, name(F.col("keeper"))).alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("payload_length"), F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, **kw) -> None:
    register(pages.sparkSession)
    small_batches(pages.sparkSession)
    page_records(pages, **kw).write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(urn: Column) -> Column:
    return F.regexp_extract(urn, "^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    read = read_records(spark, path)
    # a response's length and digest are those of the payload read back; a revisit has its header's
    is_response = F.col("record_type") == "response"
    return read.where(F.col("record_type").isin("response", "revisit")).select(
        page_id(F.col("record_id")).alias("page_id"),
        F.when(is_response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("bigint").alias("payload_bytes"),
        F.when(is_response, base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page_id(F.col("refers_to")).alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes, x, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest
  FROM h),
k AS (SELECT x, max(page_id) AS keeper FROM b GROUP BY x)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM b JOIN k USING (x)
"""
