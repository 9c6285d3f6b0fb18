"""WAV files read by segment."""

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

from earshot.sources import audio, segments


def tone(n, seed=0):
    return np.round(np.random.default_rng(seed).uniform(-0.9, 0.9, n) * 32768) / 32768


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(100, tone(1050), floating=False))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "stereo.wav").write_bytes(audio.encode_wav(100, np.stack([tone(230, 1), tone(230, 2)], axis=1)))
    (tmp_path / "bad.wav").write_bytes(b"RIFF\0\0\0\0nothing")
    (tmp_path / "empty.wav").write_bytes(audio.encode_wav(100, np.zeros((0, 1))))
    (tmp_path / "nil.wav").write_bytes(b"")
    (tmp_path / "other.txt").write_text("no sound")
    return tmp_path


@pytest.mark.parametrize("range_bytes", [100, 401, 10**6])
def test_segments_make_up_the_files(spark, folder, range_bytes):
    rows = segments.read_segments(spark, str(folder), segment_s=1.0, range_bytes=range_bytes).orderBy("path", "start").collect()
    sound = {}
    for r in rows:
        if r.error is None:
            sound.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert {r.path.rpartition("/")[2] for r in rows if r.error} == {"bad.wav", "nil.wav"} and set(sound) == {"a.wav", "stereo.wav"}
    mono = sound["a.wav"]
    assert [r.start for r in mono] == list(range(0, 1050, 100)) and np.concatenate([r.left for r in mono]).tolist() == tone(1050).tolist()
    assert {(r.total_samples, r.sample_rate, r.channels, r.right) for r in mono} == {(1050, 100, 1, None)}
    stereo = sound["stereo.wav"]
    assert np.allclose(np.concatenate([r.left for r in stereo]), tone(230, 1)) and np.allclose(np.concatenate([r.right for r in stereo]), tone(230, 2))


class Counting:
    """A file system that counts the bytes that are read."""

    def __init__(self):
        self.inner, self.bytes = pyarrow.fs.LocalFileSystem(), 0

    def get_file_info(self, *a):
        return self.inner.get_file_info(*a)

    def open_input_file(self, path):
        outer, file = self, self.inner.open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                file.close()

            def seek(self, at):
                file.seek(at)

            def read(self, n):
                got = file.read(n)
                outer.bytes += len(got)
                return got

        return File()


def test_a_second_of_a_long_file_is_read_without_the_rest(tmp_path):
    (tmp_path / "long.wav").write_bytes(audio.encode_wav(1000, tone(600_000), floating=False))
    reader = segments.SegmentReader(str(tmp_path), segment_s=1.0, range_bytes=200_000)
    reader.system = Counting()
    left = list(reader.pushFilters([GreaterThanOrEqual(("start",), 300_000), LessThan(("start",), 301_000), StringContains(("path",), "x")]))
    assert [type(f) for f in left] == [StringContains]
    parts = reader.partitions()
    assert len(parts) == 7
    got = [b for p in parts for b in reader.read(p)]
    assert [b.column(4)[0].as_py() for b in got] == [300_000] and got[0].column(5)[0].as_py() == tone(600_000)[300_000:301_000].tolist()
    assert reader.system.bytes < 2 * 1000 + 7 * 200
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    assert len([b for p in reader.partitions() for b in reader.read(p)]) == 1  # its start is null, which is no 300,000


def test_other_files_are_not_opened(folder):
    reader = segments.SegmentReader(str(folder))
    assert not list(reader.pushFilters([EqualTo(("path",), str(folder / "a.wav"))]))
    assert [p.path for part in reader.partitions() for p in part.of] == [str(folder / "a.wav")]


def test_conditions_reach_the_reader(spark, folder):
    rows = segments.read_segments(spark, str(folder), segment_s=1.0)
    some = rows.where((F.col("path") == str(folder / "a.wav")) & (F.col("start") >= 300) & (F.col("start") <= 500))
    assert sorted(r.start for r in some.collect()) == [300, 400, 500]
    assert rows.where(F.col("start") == 200).count() == 2 and rows.where(F.col("path").startswith(f"{folder}/b/")).count() == 3


def test_what_files_must_be(spark, folder):
    errors = lambda **how: {r.path.rpartition("/")[2]: r.error for r in segments.read_segments(spark, str(folder), **how).where("error is not null").collect()}
    assert errors(channels=1)["stereo.wav"] == "2 channels" and errors(rate=44100)["a.wav"] == "sample rate 100"
    assert segments.read_segments(spark, str(folder / "a.wav"), segment_s=100).count() == 1


def test_headers_alone(spark, folder):
    rows = segments.read_segments(spark, f"file://{folder}", signals=False).where("error is null").collect()
    assert {(r.path.rpartition("/")[2], r.total_samples, r.left) for r in rows} == {("a.wav", 1050, None), ("stereo.wav", 230, None)}
