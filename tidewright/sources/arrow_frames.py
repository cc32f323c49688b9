"""Frame archives: Arrow IPC files of each video's frames, written and read as a data source, with seeks to the record batches in need.

A video's frames lie in one file or several, "<video>-<part>.arrow", in order of part; a frame's number is its place in all of them. A reader
walks the messages' headers and fetches the bodies of those batches only that hold wanted frames, in the file format as in the stream format. A folder's
files are dealt to tasks by size, and the batches of one large file by byte ranges.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Columns of a stored frame; the data source adds the video and the frame's number.
STORED = pa.schema([("image", pa.string()), ("feature", pa.binary())])
SCHEMA = "video_uid string, frame_idx long, image string, feature binary"
_MAGIC, _SCHEMA, _BATCH = b"ARROW1\0\0", 1, 3


class DamagedFile(ValueError):
    """A file that ends or breaks off before its end mark."""


@dataclass
class Message:
    """Where a message lies, what kind it is, and its number of rows."""

    at: int
    size: int
    kind: int
    rows: int


def _field(meta: bytes, table: int, number: int) -> int:
    """Where the field of a flatbuffer's *table* lies; 0 if it isn't there."""
    vtable = table - struct.unpack_from("<i", meta, table)[0]
    size = struct.unpack_from("<H", meta, vtable)[0]
    at = 4 + 2 * number
    offset = struct.unpack_from("<H", meta, vtable + at)[0] if at < size else 0
    return table + offset if offset else 0


def messages(file, path: str) -> Iterator[Message]:
    """The messages of an open Arrow file or stream, by their headers alone; ends at the end mark, or raises DamagedFile."""
    at = len(_MAGIC) if file.read(len(_MAGIC)) == _MAGIC else 0
    while True:
        file.seek(at)
        head = file.read(8)
        if len(head) < 8 or head[:4] != b"\xff\xff\xff\xff":
            raise DamagedFile(f"{path}: no message at byte {at}")
        length = struct.unpack_from("<i", head, 4)[0]
        if length == 0:
            return
        meta = file.read(length)
        if len(meta) < length or length < 16:
            raise DamagedFile(f"{path}: message cut off at byte {at}")
        table = struct.unpack_from("<I", meta)[0]
        kind, header, body = (_field(meta, table, k) for k in (1, 2, 3))
        size = 8 + length + (struct.unpack_from("<q", meta, body)[0] if body else 0)
        if at + size > file.size():
            raise DamagedFile(f"{path}: message cut off at byte {at}")
        rows = 0
        if meta[kind] == _BATCH:
            batch = header + struct.unpack_from("<I", meta, header)[0]
            place = _field(meta, batch, 0)
            rows = struct.unpack_from("<q", meta, place)[0] if place else 0
        yield Message(at, size, meta[kind], rows)
        at += size


def frames_between(files: list[str], start: int, end: int | None, opened: Callable, part: tuple[int, int, int] | None = None, strict: bool = True) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number of the first frame, batch) for the frames *start* up to, not including, *end* of one video's *files* in order.

    *part* (file, low, high): only batches of that file that begin in this range of bytes. A damaged file raises DamagedFile; without *strict* its
    frames before the damage count, and those of later files follow on them. Frames beyond the last are left out.
    """
    frame = 0
    for i, path in enumerate(files):
        with opened(path) as file:
            others: list[bytes] = []  # the schema, and dictionaries if there are any
            try:
                for m in messages(file, path):
                    if m.kind != _BATCH:
                        file.seek(m.at)
                        others.append(file.read(m.size))
                        continue
                    first, frame = frame, frame + m.rows
                    if end is not None and first >= end:
                        return
                    mine = part is None or part[0] == i and part[1] <= m.at < part[2]
                    if mine and frame > start and m.rows:
                        file.seek(m.at)
                        whole = pa.ipc.open_stream(b"".join([*others, file.read(m.size), b"\xff\xff\xff\xff\0\0\0\0"])).read_next_batch()
                        low = max(start - first, 0)
                        yield first + low, whole.slice(low, (min(frame, end) if end is not None else frame) - first - low)
            except (DamagedFile, pa.ArrowInvalid):
                if strict:
                    raise


def _store(path: str):
    """Arrow's file system for *path*, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _open(path: str):
    store, inner = _store(path)
    return store.open_input_file(inner)


def _videos(path: str) -> dict[str, list[tuple[str, int]]]:
    """Each video's files with their sizes, in order of part."""
    from pyarrow import fs

    store, inner = _store(path)
    found: dict[str, list[tuple[int, str, int]]] = {}
    for info in store.get_file_info(fs.FileSelector(inner)):
        name, dot, kind = info.base_name.rpartition(".")
        video, dash, number = name.rpartition("-")
        if kind == "arrow" and dash and number.isdigit():
            found.setdefault(video, []).append((int(number), f"{path.rstrip('/')}/{info.base_name}", info.size))
    return {video: [x[1:] for x in sorted(files)] for video, files in found.items()}


@dataclass
class _Part(InputPartition):
    """Whole videos, or a range of bytes of one file of a video."""

    videos: list[tuple[str, list[str]]]
    range: tuple[int, int, int] | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("splitbytes", 128 << 20))
        self.start, end = int(options.get("start", 0)), options.get("end")
        self.end, self.strict = (None if end is None else int(end)), options.get("damaged", "fail") == "fail"

    def partitions(self) -> list[_Part]:
        """Small videos together up to the split size; the files of larger ones by ranges of that many bytes."""
        out, open_part, size = [], [], 0
        for video, files in sorted(_videos(self.path).items()):
            names, own = [f for f, _ in files], sum(s for _, s in files)
            if own > self.bytes:
                out += [_Part([(video, names)], (i, low, low + self.bytes)) for i, (_, s) in enumerate(files) for low in range(0, s, self.bytes)]
                continue
            if open_part and size + own > self.bytes:
                out.append(_Part(open_part))
                open_part, size = [], 0
            open_part.append((video, names))
            size += own
        return out + ([_Part(open_part)] if open_part else [])

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for video, files in partition.videos:
            for first, batch in frames_between(files, self.start, self.end, _open, partition.range, self.strict):
                n = batch.num_rows
                columns = [pa.array([video] * n), pa.array(range(first, first + n), pa.int64()), *(batch.column(c) for c in STORED.names)]
                yield pa.RecordBatch.from_arrays(columns, ["video_uid", "frame_idx", *STORED.names])


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Each task writes beside the archive, and the driver moves what the tasks that counted have written into it."""

    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"].rstrip("/"), int(options.get("batchrows", 64))
        self.aside = f"{self.path}/.part-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Rows come by video and frame. A task holds one record batch of the archive."""
        store, folder = _store(self.aside)
        folder = f"{folder}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        files, video, sink, held = [], None, None, []

        def flush(least: int) -> None:
            nonlocal held
            while sum(map(len, held)) >= max(1, least):
                table = pa.concat_tables(held).combine_chunks()
                sink.write_table(table.slice(0, self.rows), self.rows)
                held = [table.slice(self.rows)] if len(table) > self.rows else []

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            uids = table.column("video_uid").to_pylist()
            cuts = [0, *(i for i in range(1, len(uids)) if uids[i] != uids[i - 1]), len(uids)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if uids[low] != video:
                    if sink is not None:
                        flush(1)
                        sink.close()
                    video = uids[low]
                    files.append(f"{folder}/{video}-0.arrow")
                    sink = pa.ipc.new_file(store.open_output_stream(files[-1]), STORED)
                held.append(table.slice(low, high - low).select(STORED.names).cast(STORED))
                flush(self.rows)
        if sink is not None:
            flush(1)
            sink.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        """A video that is there already goes on in a new part."""
        store, inner = _store(self.path)
        there = {video: len(files) for video, files in _videos(self.path).items()}
        for file in [f for m in messages if m for f in m.files]:
            video = file.rpartition("/")[2].rpartition("-")[0]
            store.move(file, f"{inner}/{video}-{there.get(video, 0)}.arrow")
        store.delete_dir(_store(self.aside)[1])

    def abort(self, messages: list[_Written | None]) -> None:
        store, aside = _store(self.aside)
        store.delete_dir(aside)


class FrameArchive(DataSource):
    """frame_archive: options path, start and end (frames of each video), splitBytes, batchRows, and damaged (fail, or keep what comes before)."""

    @classmethod
    def name(cls) -> str:
        return "frame_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a frame archive is appended to; write to a new folder instead")
        return _Writer(self.options)


def write_frames(frames: DataFrame, path: str, batch_rows: int = 64) -> None:
    """Append *frames* (video_uid, frame_idx, image, feature) to the archive at *path*, each video's in order of frame_idx."""
    frames.sparkSession.dataSource.register(FrameArchive)
    rows = frames.selectExpr("CAST(video_uid AS STRING) AS video_uid", "CAST(frame_idx AS LONG) AS frame_idx", "image", "feature")
    rows.repartition("video_uid").sortWithinPartitions("video_uid", "frame_idx").write.format("frame_archive").mode("append").option("path", path).option("batchRows", batch_rows).save()


def read_frames(spark: SparkSession, path: str, start: int = 0, end: int | None = None, damaged: str = "fail", **options) -> DataFrame:
    """Frames *start* up to, not including, *end* of every video of the archive at *path*."""
    spark.dataSource.register(FrameArchive)
    reader = spark.read.format("frame_archive").options(path=path, start=start, damaged=damaged, **options)
    return (reader.option("end", end) if end is not None else reader).load()


def read_clips(clips: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """(video_uid, clip, frame_idx, image, feature) of *clips* (video_uid, clip, clip_start, clip_end): half open ranges of frames, each fetched by itself.

    A clip of a video that isn't there has no frames; with *strict* a clip that ends beyond its video, or an empty one, is an error, else it is cut.
    """
    spark = clips.sparkSession
    files = spark.createDataFrame([(v, [f for f, _ in fs]) for v, fs in _videos(path).items()], "uid string, files array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, end, n = row["clip_start"], row["clip_end"], 0
                for first, found in frames_between(row["files"], start, end, _open):
                    n += found.num_rows
                    columns = [pa.array([row[c]] * found.num_rows, kind) for c, kind in (("video_uid", pa.string()), ("clip", pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(first, first + found.num_rows), pa.int64()), *(found.column(c) for c in STORED.names)], ["video_uid", "clip", "frame_idx", *STORED.names])
                if strict and (end <= start or n < end - start):
                    raise ValueError(f"clip {row['clip']} of {row['video_uid']} asks for frames {start} to {end}, of which {n} are there")

    rows = clips.selectExpr("CAST(video_uid AS STRING) AS video_uid", "CAST(clip AS LONG) AS clip", "CAST(clip_start AS LONG) AS clip_start", "CAST(clip_end AS LONG) AS clip_end")
    met = rows.join(files, rows["video_uid"] == files["uid"]).select("video_uid", "clip", "clip_start", "clip_end", "files")
    return met.mapInArrow(run, "video_uid string, clip long, frame_idx long, image string, feature binary")
