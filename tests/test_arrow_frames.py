"""Frame archives: seeks, appended parts, byte ranges, both formats, damaged and short files."""

from __future__ import annotations

import pyarrow as pa
import pytest

from tidewright.sources import arrow_frames as A

FRAMES = "video_uid string, frame_idx long, image string, feature binary"


@pytest.fixture
def archive(spark, tmp_path):
    rows = [(v, i, f"{v}{i}" * 500, bytes([i]) if i % 3 == 0 else None) for v, n in (("a", 100), ("b-2", 7), ("c", 1)) for i in range(n)]
    A.write_frames(spark.createDataFrame(rows, FRAMES).repartition(3), str(tmp_path), batch_rows=10)
    A.write_frames(spark.createDataFrame([("a", 100 + i, "more", None) for i in range(5)], FRAMES), str(tmp_path), batch_rows=10)
    return str(tmp_path)


def test_reads_back_what_was_written_and_appended(spark, archive):
    got = A.read_frames(spark, archive).orderBy("video_uid", "frame_idx").collect()
    assert [(r.video_uid, r.frame_idx) for r in got] == [("a", i) for i in range(105)] + [("b-2", i) for i in range(7)] + [("c", 0)]
    assert all(r.image == (f"{r.video_uid}{r.frame_idx}" * 500 if r.frame_idx < 100 else "more") for r in got)
    assert all((r.feature is not None) == (r.frame_idx % 3 == 0 and r.frame_idx < 100) for r in got)
    few = A.read_frames(spark, archive, 5, 12, splitBytes=20_000)
    assert few.rdd.getNumPartitions() > 2  # video a in ranges of bytes
    assert sorted((r.video_uid, r.frame_idx) for r in few.collect()) == [("a", i) for i in range(5, 12)] + [("b-2", 5), ("b-2", 6)]


class Counting:
    def __init__(self, path: str) -> None:
        self.file, self.count = A._open(path), 0
        self.whole = self.file.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, at: int) -> None:
        self.file.seek(at)

    def size(self) -> int:
        return self.whole

    def read(self, n: int) -> bytes:
        out = self.file.read(n)
        self.count += len(out)
        return out


def test_a_range_reads_only_its_batches(archive):
    files, opened = [f for f, _ in A._videos(archive)["a"]], []
    assert [f.rpartition("/")[2] for f in files] == ["a-0.arrow", "a-1.arrow"]

    def counted(path: str) -> Counting:
        opened.append(Counting(path))
        return opened[-1]

    got = [(first, len(batch)) for first, batch in A.frames_between(files, 42, 55, counted)]
    assert got == [(42, 8), (50, 5)]
    assert len(opened) == 1 and opened[0].count < 0.35 * opened[0].size()  # two of ten batches, and headers


def test_stream_format_and_dictionaries(tmp_path):
    path = str(tmp_path / "x-0.arrow")
    schema = pa.schema([("image", pa.dictionary(pa.int8(), pa.string())), ("feature", pa.binary())])
    with pa.ipc.new_stream(path, schema) as sink:
        for i in range(5):
            sink.write_batch(pa.record_batch([pa.array(["p", "q"]).dictionary_encode().cast(schema.field(0).type), pa.array([b"", bytes([i])])], schema=schema))
    got = [(first, b.column(0).to_pylist(), b.column(1).to_pylist()) for first, b in A.frames_between([path], 3, 6, A._open)]
    assert got == [(3, ["q"], [b"\x01"]), (4, ["p", "q"], [b"", b"\x02"])]


def test_damaged_files(spark, archive):
    path = f"{archive}/a-0.arrow"
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="a-0.arrow: message cut off"):
        A.read_frames(spark, archive).collect()
    kept = [r.frame_idx for r in A.read_frames(spark, archive, damaged="keep").filter("video_uid = 'a'").orderBy("frame_idx").collect()]
    assert 30 <= len(kept) < 60 and kept == list(range(len(kept)))  # whole batches before the damage, then the second part
    open(path, "wb").write(b"")
    with pytest.raises(Exception, match="no message at byte 0"):
        A.read_frames(spark, archive).collect()
    assert A.read_frames(spark, archive, damaged="keep").filter("video_uid = 'a'").count() == 5


def test_clips(spark, archive):
    clips = lambda *rows: spark.createDataFrame(list(rows), "video_uid string, clip long, clip_start long, clip_end long")
    got = A.read_clips(clips(("a", 1, 98, 103), ("a", 2, 0, 1), ("b-2", 3, 6, 7), ("gone", 4, 0, 1)), archive).collect()
    assert sorted((r.clip, r.frame_idx) for r in got) == [(1, i) for i in range(98, 103)] + [(2, 0), (3, 6)]
    with pytest.raises(Exception, match="clip 9 of b-2 asks for frames 5 to 8, of which 2 are there"):
        A.read_clips(clips(("b-2", 9, 5, 8)), archive).collect()
    with pytest.raises(Exception, match="clip 8 of c"):
        A.read_clips(clips(("c", 8, 1, 1)), archive).collect()
    assert A.read_clips(clips(("b-2", 9, 5, 8)), archive, strict=False).count() == 2
