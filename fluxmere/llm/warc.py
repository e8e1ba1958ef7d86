"""WARC archives: a data source that writes and reads them, and payload deduplication.

Archives are ``.warc.gz`` with one gzip member a record. A member's header has its length
in an extra field, so a reader decodes a record's WARC headers first and, if the record or
its payload isn't wanted, goes on at the next member without decoding the rest. Members
without that field and plain ``.warc`` files are read too, one after the other.

Write tasks name their files freely and the commit writes a manifest of those that count;
readers go by the manifest, so lost and repeated tasks leave no trace. Each file is an
input partition. Filters on header columns are pushed down to the reader.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .storage import cut, fresh_path, remove_at_end, sent_if_small, ship

NAME = "fluxmere_warc"
MANIFEST = "_manifest.json"
LEAST_REVISIT = 100
COLUMNS = "record_type string, record_id string, url string, date string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ID = "<urn:page:"
_DATE = "2024-01-01T00:00:00Z"
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 2000


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _full(spark: SparkSession, path: str) -> str:
    """With the scheme of the cluster's default file system, if it has none."""
    if ":/" in path:
        return path
    default = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").rstrip("/")
    return default + path if "://" in default and not default.startswith("file") else path


def _record(row: dict) -> bytes:
    """Uncompressed WARC record."""
    kind, payload = row["record_type"], row["payload"] or b""
    block = _HTTP + (payload if kind == "response" else b"")
    url = "" if row["url"] is None else quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~-._")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}"]
    if row["url"] is not None:
        lines += [f"WARC-Target-URI: {url}", f"X-Target: {quote(row['url'], safe='')}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_ID}{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = 12 + 4 + 16
    extra = b"sl" + struct.pack("<HQQ", 16, head + len(body) + 8, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open_fs(self.path)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(_member(_record(row)))
                n += 1
        if out is not None:
            out.close()
        return _Written(name if n else None, n)

    def commit(self, messages: list) -> None:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted(m.file for m in messages if m and m.file)
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = _open_fs(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root}/{m.file}")


@dataclass
class _File(InputPartition):
    path: str


class _Stream:
    """Decoded bytes of one gzip member, or of a plain file, as far as they are asked for."""

    def __init__(self, source, plain: bool):
        self.source, self.plain, self.buffer = source, plain, b""
        self.inflate = None if plain else zlib.decompressobj(31)
        self.over = False

    def more(self) -> bool:
        raw = self.source.read(16384)
        if not raw:
            self.over = True
            return False
        self.buffer += raw if self.plain else self.inflate.decompress(raw)
        if not self.plain and self.inflate.eof:
            self.source.seek(self.source.tell() - len(self.inflate.unused_data))
            self.over = True
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if self.over or not self.more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and not self.over:
            self.more()
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def drain(self) -> None:
        while not self.over:
            self.buffer = b""
            self.more()


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _columns(h: dict[str, str]) -> dict:
    refers = h.get("warc-refers-to", "")
    url = unquote(h["x-target"]) if "x-target" in h else h.get("warc-target-uri")
    return {
        "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "url": url, "date": h.get("warc-date"), "page_id": _number(h.get("x-page-id")),
        "refers_to": _number(refers[len(_ID) : -1]) if refers.startswith(_ID) else None, "payload_digest": h.get("warc-payload-digest", "").partition(":")[2] or None, "payload_bytes": _number(h.get("x-payload-length")), "payload": None,
    }


_TESTS = {
    "=": lambda x, v: x == v,
    "<=>": lambda x, v: x == v,
    "in": lambda x, v: x in v,
    "<": lambda x, v: x < v,
    "<=": lambda x, v: x <= v,
    ">": lambda x, v: x > v,
    ">=": lambda x, v: x >= v,
}


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "=", EqualNullSafe: "<=>", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.tests.append((f.attribute[0], signs[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open_fs(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                return [_File(f"{root}/{x}") for x in json.loads(f.read())]
        found = fs.get_file_info(pafs.FileSelector(root))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))]

    def wanted(self, row: dict) -> bool:
        return all((row[c] is None and v is None and sign == "<=>") or (row[c] is not None and v is not None and _TESTS[sign](row[c], v)) for c, sign, v in self.tests)

    def rows(self, path: str) -> Iterator[dict]:
        fs, _ = _open_fs(self.path)
        with fs.open_input_file(path) as source:
            size, stream = source.size(), None
            while True:
                at, after = source.tell(), None
                if stream is None:
                    if at >= size:
                        return
                    head = source.read(32)
                    if head[:2] == b"\x1f\x8b":
                        if len(head) == 32 and head[3] & 4 and head[12:16] == b"sl\x10\0":
                            after = at + struct.unpack("<Q", head[16:24])[0]
                        source.seek(at)
                        stream = _Stream(source, False)
                    else:
                        source.seek(at)
                        stream = _Stream(source, True)
                raw = stream.until(b"\r\n\r\n")
                if raw is None:
                    if stream.plain:
                        return
                    stream = None
                    continue
                headers = _headers(raw.lstrip(b"\r\n"))
                row, length = _columns(headers), int(headers.get("content-length", 0))
                wanted = self.wanted(row)
                if wanted and self.payload and row["record_type"] == "response":
                    block = stream.take(length)
                    length = 0
                    row["payload"] = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                if wanted:
                    yield row
                if after is not None:  # the next member, whatever is left of this one
                    source.seek(after)
                    stream = None
                else:
                    while length > 0 and (got := len(stream.take(min(length, 1 << 20)))):
                        length -= got
                    stream.take(4)

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive in the folder
            return
        rows, size = [], 0
        for row in self.rows(partition.path):
            rows.append(row)
            size += len(row["payload"] or b"")
            if size > _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcDataSource(DataSource):
    """Options: path; payload (true or false): false leaves all payloads undecoded and null."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("payload", str(payload).lower()).load(_full(spark, path))


def records(pages: DataFrame) -> DataFrame:
    """One record for each row of ``pages(page_id, url, html)``, in the columns of the source.

    Of records with equal payloads of at least 100 bytes that with the smallest page_id is
    the response and others revisit it; all others are responses. Null html is an empty
    payload. Rows that repeat a page_id and its payload are alike; a null page_id with
    the payload of another page revisits that, else it is a response.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    narrow = cut(rows.where(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", "payload_digest"))
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = cut(narrow.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct())
    again = sent_if_small(again.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to"))
    out = rows.join(again, rows.page_id.eqNullSafe(F.col("_page")) & (rows.payload_digest == F.col("_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    return out.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.concat(F.lit(_ID), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"), "url", F.lit(_DATE).alias("date"),
        "page_id", "refers_to", "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages, in a folder that driver and executors share."""
    spark = pages.sparkSession
    register(spark)
    records(pages).write.format(NAME).mode("append").save(_full(spark, path))


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives, for the application's time where no path is given, and read them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests of responses are those of the payloads read back, of revisits those in
    their headers.
    """
    spark = pages.sparkSession
    if path is None:
        path = fresh_path(spark, "warc")
        remove_at_end(spark, path)
    write(pages, path)
    back = read(spark, path)
    whole = F.col("record_type") == "response"
    return back.select("page_id", "url", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
