"""WARC archives with a two-level capture index.

Writing: a page whose payload equals that of a page with a larger id becomes a revisit record that refers to it; every
record is a gzip member of its own in archives of bounded size that Spark's writer commits. The index is made from the archives
themselves: keys (reversed host, path, time, page) are sorted by range, packed into compressed blocks of lines, and
a sparse directory keeps each block's first key. Reading: a key's part and then its block are found by binary search in
the directory, the line by binary search in the block, and the record by reading the byte range that the line names.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from base64 import b32encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.shared import written
from tidewright.sources.scratch import scratch_path

_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
#: An empty gzip member. Spark's text writer ends each row with a separator; this one is part of a valid .gz file.
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31)
_EMPTY_MEMBER = (_EMPTY_MEMBER.compress(b"") + _EMPTY_MEMBER.flush()).decode("latin-1")


def digest_of(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The URL with its host reversed, so that a site's pages sort together: com,example,www)/path?query."""
    url = "".join((url or "").split())
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return "!" + url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """What the index sorts by: URL key, time and page; unique as far as page_id is."""
    return f"{url_key(url)} {_DATE} " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode("utf-8", "replace")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The gzip member of a response, or of a revisit where *refers_to* is given. A revisit keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", _DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", "".join(url.split())))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"))
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(_header(lines) + block + b"\r\n\r\n") + out.flush()


@dataclass
class Record:
    """A record as read: header fields, HTTP header fields, payload (empty for a revisit)."""

    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return _page(self.fields["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return _page(self.fields["warc-refers-to"]) if "warc-refers-to" in self.fields else None


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def _fields(raw: bytes) -> dict[str, str]:
    rows = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, _fields(http), payload)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty. After a damaged one the next member's start is looked for."""
    at = 0
    while at < len(data):
        out = zlib.decompressobj(31)
        size, parts, pos = 1 << 16, [], at
        try:
            while not out.eof and pos < len(data):  # in steps, so that the rest of the file isn't copied for each member
                parts.append(out.decompress(data[pos : pos + size]))
                pos += size
        except zlib.error:
            parts = []
        if not out.eof:  # damaged, or cut off
            later = data.find(b"\x1f\x8b\x08", at + 1)
            at = len(data) if later < 0 else later
            continue
        end = min(pos, len(data)) - len(out.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def write_archives(pages: DataFrame, archive_bytes: int = 16 << 20) -> str:
    """Write a record per row of *pages* (page_id, url, html) and return the archives' folder, below the shared one.

    An archive is closed once it holds *archive_bytes*, so it is larger by one record at most.

    Of rows with equal payloads those with the largest page_id are responses and the others revisit it. Null html is an
    empty payload. Rows without page_id revisit like others, but are never referred to: where no row has one, all are
    responses. Rows that repeat a page_id have a record each. Payloads of any length are kept whole, a null url is left out of
    the header, and other columns don't matter. An empty table gives archives without records.
    """
    payload = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", F.sha1(payload.cast("binary")).alias("sha")).distinct()
    largest = slim.groupBy("sha").agg(F.max("page_id").alias("keeper"))
    roles = slim.join(largest, "sha").select(
        F.col("page_id").alias("_p"), F.col("sha").alias("_s"), F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to")
    )
    full = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha"))
    met = full.join(roles.hint("shuffle_hash"), (full["sha"] == roles["_s"]) & full["page_id"].eqNullSafe(roles["_p"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for p, u, h, r in zip(*[c.to_pylist() for c in batch.slice(i, 256).columns], strict=True):
                    held.append(record_bytes(p, u, (h or "").encode("utf-8", "replace"), r))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    folder = scratch_path(pages.sparkSession, "warc")
    archives = met.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInArrow(run, "archive binary")
    # the text writer copies a string's bytes as they are, so it serves as Spark's committed writer of raw files, one a row
    writer = archives.select(F.col("archive").cast("string")).write.option("lineSep", _EMPTY_MEMBER).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", 1).text(folder)
    return folder


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def build_index(spark: SparkSession, folder: str, block_lines: int = 500, part_lines: int = 100_000) -> str:
    """Index the archives in *folder* and return the index's folder: blocks (the compressed lines) and directory.

    Each part of the index is a range of lines, so that even the captures of one key are split. The directory's rows are (part, first
    key); it is a *block_lines*-th of the index. Records that are damaged, cut off or no WARC records are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, lines = [], []
                for offset, length, content in members(data.as_py()):
                    try:
                        record = parse_record(content)
                        key = capture_key(record.fields.get("warc-target-uri"), record.page_id)
                        line = json.dumps({"file": path, "offset": offset, "length": length, "type": record.fields["warc-type"], "digest": record.fields["warc-payload-digest"]})
                    except (KeyError, ValueError):
                        continue
                    keys.append(key)
                    lines.append(line)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], ["key", "line"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        first: list[str] = []

        def block() -> pa.RecordBatch:
            blob = zlib.compress("\n".join(held).encode(), 6)
            row = [[first[0]], [len(held)], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["first_key", "n", "blob"])

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(f"{key} {line}")
                first.append(key)
                if len(held) == block_lines:
                    yield block()
                    held.clear()
                    first.clear()
        if held:
            yield block()

    entries = written(_archives(spark, folder).mapInArrow(scan, "key string, line string"), "captures")
    parts = max(1, math.ceil(entries.count() / part_lines))
    blocks = entries.repartitionByRange(parts, "key", "line").sortWithinPartitions("key", "line").mapInArrow(pack, "first_key string, n int, blob binary")
    where = scratch_path(spark, "cdx")
    blocks.withColumn("part", F.spark_partition_id()).write.parquet(f"{where}/blocks")
    spark.read.parquet(f"{where}/blocks").select("part", "first_key").write.parquet(f"{where}/directory")
    return where


def search_blocks(keys: list[str], first_keys: list[str], blobs: list[bytes]) -> Iterator[tuple[str, dict]]:
    """(key, entry) of each of the sorted *keys* that the blocks (sorted by first key) hold; every capture of a repeated key."""
    opened, lines, line_keys = -1, [], []
    for key in keys:
        at = max(0, bisect_left(first_keys, key) - 1)  # equal keys may begin in the block before
        while at < len(first_keys) and (first_keys[at] <= key):
            if at != opened:
                lines = zlib.decompress(blobs[at]).decode().split("\n")
                line_keys, opened = [" ".join(x.split(" ", 3)[:3]) for x in lines], at
            for i in range(bisect_left(line_keys, key), bisect_right(line_keys, key)):
                yield key, json.loads(lines[i].split(" ", 3)[3])
            at += 1


def look_up(captures: DataFrame, index: str) -> DataFrame:
    """(file, offset, length) of each of *captures* (page_id, url) that the index holds, found by two binary searches.

    Each key goes to the parts of the index that may hold it: these ranges are few (part_lines captures each), and their first
    keys are sent to the executors. There the part's directory and blocks are searched. Captures that repeat are looked for once, and
    all records of a key are found. A null url is looked for as an empty one. An empty index or table gives no rows.
    """
    spark = captures.sparkSession
    blocks = spark.read.parquet(f"{index}/blocks")
    parts = sorted((r[1], r[0]) for r in spark.read.parquet(f"{index}/directory").groupBy("part").agg(F.min("first_key")).collect())
    firsts, numbers = [k for k, _ in parts], [p for _, p in parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, keys = [], []
            for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = capture_key(u, p)
                own = numbers[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]
                to += own
                keys += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(keys, pa.string())], ["part", "key"])

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        order = held.sort_by("first_key")
        keys = sorted(asked.column("key").to_pylist())
        found = [e for _, e in search_blocks(keys, order.column("first_key").to_pylist(), order.column("blob").to_pylist())]
        return pa.table([pa.array([e["file"] for e in found], pa.string()), pa.array([e["offset"] for e in found], pa.int64()), pa.array([e["length"] for e in found], pa.int64())], ["file", "offset", "length"])

    keyed = captures.select(F.col("page_id").cast("long"), "url").mapInArrow(route, "part int, key string").distinct()
    return keyed.groupBy("part").cogroup(blocks.select("part", "first_key", "blob").groupBy("part")).applyInArrow(find, "file string, offset long, length long")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows_of(members: Iterator[bytes]) -> pa.RecordBatch:
    """What is returned of the records in gzip *members*."""
    rows = []
    for member in members:
        record = parse_record(zlib.decompress(member, 31))
        kind = record.fields["warc-type"]
        digest = digest_of(record.payload) if kind == "response" else record.fields["warc-payload-digest"].removeprefix("sha1:")
        size = len(record.payload) if kind == "response" else int(record.http["content-length"])
        rows.append((record.page_id, record.fields.get("warc-target-uri"), size, digest, kind, record.refers_to))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _opens(folder: str) -> bool:
    """Whether Arrow has a file system for *folder*'s store."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def read_ranges(spark: SparkSession, folder: str, ranges: DataFrame, direct: bool | None = None) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records at *ranges* (file, offset, length).

    A response's length and digest are those of the payload that is read; a revisit's are those that its record keeps. The
    executors seek in the archives and read the ranges alone. Where Arrow has no file system for the store (*direct* is found
    out, if not given), the archives come through Spark's reader and meet their ranges by file. No ranges give no rows.
    """

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened, stream = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found = []
                for file, offset, length in zip(*[c.to_pylist() for c in batch.slice(i, 256).columns], strict=True):
                    if file != opened:
                        if stream is not None:
                            stream.close()
                        # Hadoop writes file:/x where others expect file:///x
                        store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                        opened, stream = file, store.open_input_file(path)
                    found.append(stream.read_at(length, offset))
                yield _rows_of(found)

    def read(asked: pa.Table, held: pa.Table) -> pa.Table:
        data = held.column("content").chunk(0)[0].as_buffer()
        places = sorted(zip(asked.column("offset").to_pylist(), asked.column("length").to_pylist(), strict=True))
        return pa.Table.from_batches([_rows_of(data.slice(offset, length).to_pybytes() for offset, length in places)])

    if _opens(folder) if direct is None else direct:
        return ranges.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(seek, _READ)
    files = _archives(spark, folder).withColumnRenamed("path", "file")
    n = max(1, files.select("file").count())  # a partition an archive, whatever the session's number: their bytes are what a task holds
    return ranges.repartition(n, "file").groupBy("file").cogroup(files.repartition(n, "file").groupBy("file")).applyInArrow(read, _READ)


class CaptureIndex:
    """Look-ups of single URLs from the driver, by real range reads through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, index: str) -> None:
        self.spark, self.index = spark, index

    def captures(self, url: str) -> list[Record]:
        """The records of *url*. Reads the directory rows and blocks that may hold its key, and then only the records' bytes."""
        key = url_key(url)
        low, high = key + " ", key + "!"
        directory = self.spark.read.parquet(f"{self.index}/directory")
        before = directory.filter(F.col("first_key") <= low).agg(F.max("first_key")).first()[0]
        near = (F.col("first_key") < high) & (F.col("first_key") >= (before or ""))
        found = []
        for row in self.spark.read.parquet(f"{self.index}/blocks").filter(near).orderBy("first_key").collect():
            lines = zlib.decompress(row["blob"]).decode().split("\n")
            found += [json.loads(x.split(" ", 3)[3]) for x in lines[bisect_left(lines, low) : bisect_left(lines, high)]]
        return [parse_record(zlib.decompress(self._range(e["file"], e["offset"], e["length"]), 31)) for e in found]

    def _range(self, file: str, offset: int, length: int) -> bytes:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(file)
        stream = where.getFileSystem(context._jsc.hadoopConfiguration()).open(where)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(length))
        finally:
            stream.close()
