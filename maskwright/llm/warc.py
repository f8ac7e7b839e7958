"""WARC archives of a page table, and a two-level capture index over them.

Writing: one record per page. Of pages with equal payloads (SHA-1 and length), the one with the smallest
page_id becomes a `response`; the others become `revisit` records, which carry the HTTP header with the
full payload's length, its digest and a reference, and no payload. Payloads below `revisit_from` bytes
are always responses. Each record is a gzip member of its own; members are laid end to end by Spark's own
writer, whose row separator is set to an empty gzip member, so every file is a regular .warc.gz.

A file ends behind the record with which it reaches `file_bytes`, so its size is bounded by that and one record.

Index: lines `urlkey, page, file, offset, length` sorted by reversed-host URL key are cut into compressed
blocks; a sparse directory keeps the first key of each block. A lookup finds its first block by the greatest first key below the
wanted one, searches the blocks, and reads just the byte ranges of the records. Reading all records deals the index entries, not the
archives, to tasks: each opens a file and reads ranges, neighbours in one go. Files are opened through Arrow's file systems; where those
don't know the store, a range is cut out of the file as Spark reads it. The index itself is made by one streaming pass over each file.

Edge cases: a null html is an empty payload, a null url is an empty target; control characters of a URL are percent-encoded in
headers; rows that repeat the smallest page_id of their class are all responses; a null page_id is never the smallest: it revisits the class's smallest, and
where a class has null page_ids only, all are responses; other columns are ignored; an empty table makes empty archives, index and results.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, text_or_empty

DATE = "2020-01-01T00:00:00Z"
FILE_BYTES = 16 << 20
READ_BYTES = 4 << 20
SEPARATOR = gzip.compress(b"", mtime=0)
BLOCK_LINES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def url_key(url: str) -> str:
    """Host labels reversed and joined by commas, then path and query: captures of a site stand together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").strip(".")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _header_safe(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def _record(page, url, payload: bytes, size: int, sha1: str, first, first_url) -> bytes:
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header_safe(url)}", f"WARC-Payload-Digest: sha1:{base32(sha1)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Refers-To-Target-URI: {_header_safe(first_url)}", f"WARC-Refers-To-Date: {DATE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _render(file_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        archive, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            cols, records, archives = [b.column(i).to_pylist() for i in range(b.num_columns)], [], []
            for row in zip(*cols, strict=True):
                if size >= file_bytes:
                    archive, size = archive + 1, 0
                records.append(gzip.compress(_record(*row), 6, mtime=0))
                archives.append(archive)
                size += len(records[-1]) + len(SEPARATOR)
            yield pa.record_batch([pa.array(records, pa.binary()), pa.array(archives, pa.int64())], ["record", "archive"])

    return run


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a folder of one file for each archive of about file_bytes (compressed): at 100 TB give some GB, so that there are not millions of them."""
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), text_or_empty("html").alias("payload"))
    base = base.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    first = base.where(F.col("size") >= revisit_from).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.where("n > 1").drop("n"), "payload-classes")
    out = base.join(first, ["sha1", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    payload = F.when(~again, F.encode("payload", "UTF-8"))  # what a revisit doesn't hold isn't sent to Python
    out = out.select("page_id", "url", payload, "size", "sha1", F.when(again, F.col("first")), F.col("first_url"))
    # bytes that needn't be UTF-8 pass through the text writer unchanged
    members = out.mapInArrow(_render(file_bytes), "record binary, archive long").select(F.col("record").cast("string"), "archive")
    members.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).partitionBy("archive").text(path)


def _headers(raw: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in raw.split(b"\r\n")[1:])}


class Ranges:
    """A file that reads byte ranges, with a count of the bytes it has read."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(_uri(path))
        self.file, self.read_bytes = store.open_input_file(name), 0

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        self.read_bytes += len(data)
        return data

    def size(self) -> int:
        return self.file.size()


class Bytes(Ranges):
    """The same on content that was read before."""

    def __init__(self, content: bytes):
        self.content, self.read_bytes = memoryview(content), len(content)

    def read(self, at: int, size: int) -> bytes:
        return bytes(self.content[at : at + size])

    def size(self) -> int:
        return len(self.content)


def _uri(path: str) -> str:
    """Hadoop's `file:/x` is `file:///x` elsewhere."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def opens(path: str) -> bool:
    """Whether Arrow's file systems can open files of this store."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(_uri(path))
        return True
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return False


def _members(file: Ranges):
    """(record, offset, length) of each gzip member of a file, read in steps of READ_BYTES; separators are left out."""
    size, base, pos, start = file.size(), 0, 0, 0
    d, out, data = zlib.decompressobj(31), [], memoryview(b"")
    while base + pos < size:
        if pos == len(data):
            base, pos, data = base + pos, 0, memoryview(file.read(base + pos, READ_BYTES))
        part = data[pos : pos + 16384]  # what is behind a member's end is handed back, so the steps are small
        out.append(d.decompress(part))
        pos += len(part) - len(d.unused_data)
        if d.eof:
            if record := b"".join(out):
                yield record, start, base + pos - start
            d, out, start = zlib.decompressobj(31), [], base + pos
    if start < size:
        raise EOFError("a gzip member is cut short")


def _head(record: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    head = _headers(head)
    return head, rest[: int(head[b"content-length"])]


_LINES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
_LINE = "urlkey string, page string, file string, offset long, length long"


def _lines(path: str, file: Ranges):
    out = []

    def batch():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LINES, strict=True)], ["urlkey", "page", "file", "offset", "length"])

    for record, at, n in _members(file):
        head = _head(record)[0]
        out.append((url_key(head.get(b"warc-target-uri", b"").decode("utf-8", "replace")), head[b"warc-record-id"][10:-1].decode(), path, at, n))
        if len(out) == 10_000:
            yield batch()
            out.clear()
    if out:
        yield batch()


def _scan(batches):
    for b in batches:
        for path in b.column("path").to_pylist():
            yield from _lines(path, Ranges(path))


def _scan_contents(batches):
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            yield from _lines(path, Bytes(content.as_buffer()))


def _blocks(block_lines: int):
    def run(batches):
        from pyspark import TaskContext

        pid, no, lines = TaskContext.get().partitionId(), 0, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                lines.append("\t".join((row[0].replace("\t", "%09").replace("\n", "%0A"), *map(str, row[1:]))))
                if len(lines) == block_lines:
                    yield _block(pid << 32 | no, lines)
                    no, lines = no + 1, []
        if lines:
            yield _block(pid << 32 | no, lines)

    return run


def _block(no: int, lines: list[str]) -> pa.RecordBatch:
    row = ((no, pa.int64()), (lines[0].split("\t", 1)[0], pa.string()), (len(lines), pa.int64()), (zlib.compress("\n".join(lines).encode()), pa.binary()))
    return pa.record_batch([pa.array([x], t) for x, t in row], ["block", "first_key", "n_lines", "data"])


@dataclass
class CaptureIndex:
    """blocks: block, first_key, n_lines, data (a written table). archives: the folder with the files."""

    blocks: DataFrame
    archives: str


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)


def build_index(spark: SparkSession, archives: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    files = archive_files(spark, archives)
    if opens(archives):  # names are listed by Spark, and each task streams through the files it is dealt
        names = files.select("path")
        lines = names.repartition(max(1, names.count()), "path").mapInArrow(_scan, _LINE)
    else:
        lines = files.select("path", "content").mapInArrow(_scan_contents, _LINE)
    lines = materialise(lines, "index-lines")
    parts = max(1, lines.count() // (64 * block_lines)) + 1
    blocks = lines.repartitionByRange(parts, "urlkey", "page").sortWithinPartitions("urlkey", "page").mapInArrow(_blocks(block_lines), "block long, first_key string, n_lines long, data binary")
    return CaptureIndex(materialise(blocks, "index-blocks"), archives)


def _entries(batches):
    for b in batches:
        for data in b.column("data").to_pylist():
            rows = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
            yield pa.record_batch([pa.array([r[2] for r in rows]), pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([int(r[4]) for r in rows], pa.int64())], ["file", "offset", "length"])


def parse(record: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the payload (None in a revisit) of one record; a response is checked against its digest."""
    head, body = _head(gzip.decompress(record))
    kind = head[b"warc-type"].decode()
    http, _, payload = body.partition(b"\r\n\r\n")
    size, digest = int(_headers(http)[b"content-length"]), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {head[b'warc-record-id']!r}")
    ident = lambda x: int(x) if (x := x[10:-1].decode()) != "None" else None
    return ident(head[b"warc-record-id"]), size, digest, kind, ident(head[b"warc-refers-to"]) if kind == "revisit" else None, payload if kind == "response" else None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_ranges(file: Ranges, ranges: list[tuple[int, int]], gap: int = 4096):
    """The bytes of each (offset, length), in order of offset; ranges nearer than `gap` are read in one go of at most READ_BYTES or one range."""
    ranges = sorted(ranges)
    i = 0
    while i < len(ranges):
        at, to, j = ranges[i][0], sum(ranges[i]), i + 1
        while j < len(ranges) and ranges[j][0] <= to + gap and sum(ranges[j]) - at <= READ_BYTES:
            to, j = max(to, sum(ranges[j])), j + 1
        data = file.read(at, to - at)
        for o, n in ranges[i:j]:
            yield data[o - at : o - at + n]
        i = j


def _by_range(batches):
    """Entries sorted by file and offset to records."""
    for b in batches:
        files = b.column("file").to_pylist()
        ranges = list(zip(b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True))
        i = 0
        while i < len(files):
            j = i
            while j < len(files) and files[j] == files[i]:
                j += 1
            yield _table([parse(x)[:5] for x in read_ranges(Ranges(files[i]), ranges[i:j])])
            i = j


def _cut_out(entries: pa.Table, files: pa.Table) -> pa.Table:
    rows = []
    if files.num_rows and entries.num_rows:
        ranges = list(zip(entries.column("offset").to_pylist(), entries.column("length").to_pylist(), strict=True))
        rows = [parse(x)[:5] for x in read_ranges(Bytes(files.column("content")[0].as_buffer()), ranges)]
    return pa.Table.from_batches([_table(rows)])


def read_records(spark: SparkSession, index: CaptureIndex) -> DataFrame:
    """Every record that the index lists, read by its byte range from its archive."""
    entries = index.blocks.select("data").mapInArrow(_entries, "file string, offset long, length long")
    if opens(index.archives):  # a stretch of a file for each task; no archive is moved
        stretch = F.floor(F.col("offset") / (4 * READ_BYTES))
        return entries.repartition(F.col("file"), stretch).sortWithinPartitions("file", "offset").mapInArrow(_by_range, _RECORD)
    files = archive_files(spark, index.archives).select("path", "content")
    return entries.groupBy("file").cogroup(files.groupBy("path")).applyInArrow(_cut_out, _RECORD)


def find(index: CaptureIndex, url: str) -> list[tuple[str, int, int]]:
    """(file, offset, length) of the captures of one URL: one value of the directory, then the blocks that can hold the key."""
    key = url_key(_header_safe(url)).replace("\t", "%09").replace("\n", "%0A")
    start = index.blocks.where(F.col("first_key") < key).agg(F.max("first_key")).first()[0]  # columns and row groups are pruned by the written table
    held = index.blocks.where((F.col("first_key") <= key) & (F.col("first_key") >= (start if start is not None else "")))
    found = []
    for (data,) in held.select("data").toLocalIterator():
        lines = zlib.decompress(data).decode().split("\n")
        at = bisect.bisect_left(lines, key + "\t")
        while at < len(lines) and lines[at].startswith(key + "\t"):
            file, offset, length = lines[at].split("\t")[2:]
            found.append((file, int(offset), int(length)))
            at += 1
    return found


def driver_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """A byte range of a file of any store that Hadoop opens, read on the driver by seeking."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def lookup(spark: SparkSession, index: CaptureIndex, url: str) -> list[dict]:
    """All captures of one URL with their payloads: directory search, block search, range reads."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    out = [dict(zip(names, parse(driver_range(spark, *entry)), strict=True)) for entry in find(index, url)]
    return sorted(out, key=lambda r: (r["page_id"] is None, r["page_id"]))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_records(spark, build_index(spark, path))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""
