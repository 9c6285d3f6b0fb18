"""WAV files by segment: a data source that reads the ranges of files that a query asks for.

Files are listed with their sizes and cut into ranges of bytes; a task reads the
header of a file and the segments that begin in its range. Conditions on ``path``
and ``start`` are pushed down to the files and ranges that are read. A file that
cannot be read is a row with an error.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from earshot.sources.audio import WavFormat, samples_of, wav_format

COLUMNS = "path string, sample_rate int, channels int, total_samples long, start long, left array<double>, right array<double>, error string"
#: Bytes of a partition: a longer file is cut into ranges, shorter ones share a partition.
RANGE_BYTES = 64 << 20
#: Seconds of a segment.
SEGMENT_S = 10.0


@dataclass(frozen=True)
class Piece:
    """Segments of one file that begin in its bytes ``low`` to ``high``, the first piece's also before."""

    path: str
    size: int
    low: int
    high: int


@dataclass
class Pieces(InputPartition):
    of: list[Piece] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(0)


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The file system of a path or URI, the path within, and what to put before paths to name them again."""
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"), ""
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system, inner, "" if path.startswith("file://") else path[: path.index("://") + 3]


class SegmentReader(DataSourceReader):
    def __init__(self, path: str, pattern: str = "*.wav", segment_s: float = SEGMENT_S, rate: int = 0, channels: int = 0, range_bytes: int = RANGE_BYTES, signals: bool = True):
        self.system, self.root, self.prefix = opened(path)
        self.pattern, self.segment_s, self.rate, self.channels, self.range_bytes, self.signals = pattern, segment_s, rate, channels, range_bytes, signals
        self.paths: list[set[str]] = []
        self.starts: list[str] = []
        self.first, self.last, self.any_start = 0, 2**63 - 1, True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes conditions on ``path`` (equal, in, begins with) and ``start`` (compared with numbers); gives back the others."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name == "path" and isinstance(f, EqualTo):
                self.paths.append({f.value})
            elif name == "path" and isinstance(f, In):
                self.paths.append(set(f.value))
            elif name == "path" and isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif name == "start" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.any_start = False
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return fnmatch.fnmatch(posixpath.basename(path), self.pattern) and all(path in some for some in self.paths) and all(path.startswith(s) for s in self.starts)

    def partitions(self) -> Sequence[InputPartition]:
        top = self.system.get_file_info(self.root)
        files = [top] if top.is_file else self.system.get_file_info(pyarrow.fs.FileSelector(self.root, recursive=True))
        out, held = [Pieces()], 0
        for info in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            name = self.prefix + info.path
            if not self._wanted(name):
                continue
            for low in range(0, max(info.size, 1), self.range_bytes):
                high = min(low + self.range_bytes, max(info.size, 1))
                if held + high - low > self.range_bytes and out[-1].of:
                    out.append(Pieces())
                    held = 0
                out[-1].of.append(Piece(name, info.size, low, high))
                held += high - low
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.of:
            try:
                yield from self._segments(piece)
            except (OSError, ValueError, struct.error) as error:
                if piece.low == 0 and self.any_start:
                    yield self._batch(piece.path, None, None, None, str(error))

    def _segments(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        with self.system.open_input_file(piece.path.removeprefix(self.prefix)) as file:

            def read(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(n)

            form = wav_format(read, piece.size)
            if form.channels > 2 or self.channels not in (0, form.channels):
                raise ValueError(f"{form.channels} channels")
            if self.rate not in (0, form.rate):
                raise ValueError(f"sample rate {form.rate}")
            length = max(1, round(self.segment_s * form.rate))
            # the segments whose first byte lies in the piece, then those that are asked for
            to_segment = lambda byte: max(0, -(-(byte - form.start) // (length * form.step)))
            low = 0 if piece.low == 0 else to_segment(piece.low)
            low = max(low, -(-self.first // length))
            high = min(to_segment(piece.high), -(-form.samples // length), self.last // length + 1)
            for k in range(low, high):
                start = k * length
                body = read(form.start + start * form.step, min(length, form.samples - start) * form.step) if self.signals else b""
                yield self._batch(piece.path, form, start, body, None)

    def _batch(self, path: str, form: WavFormat | None, start: int | None, body: bytes | None, error: str | None) -> pa.RecordBatch:
        sides = [samples_of(form, body)[:, i] for i in range(form.channels)] if form and self.signals else []
        sides = [pa.array([s], pa.list_(pa.float64())) for s in [*sides, None, None][:2]]
        head = [pa.array([path])] + [pa.array([v], kind) for v, kind in zip((form.rate, form.channels, form.samples) if form else (None,) * 3, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*head, pa.array([start], pa.int64()), *sides, pa.array([error], pa.string())], names=[c.split()[0] for c in COLUMNS.split(", ")])


class WavSegments(DataSource):
    """``spark.read.format("wav_segments")``; options as the parameters of ``read_segments``."""

    @classmethod
    def name(cls) -> str:
        return "wav_segments"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return SegmentReader(o["path"], o.get("pattern", "*.wav"), float(o.get("segment_s", SEGMENT_S)), int(o.get("rate", 0)), int(o.get("channels", 0)), int(o.get("range_bytes", RANGE_BYTES)), o.get("signals", "true").lower() == "true")


def read_segments(spark: SparkSession, path: str, *, pattern: str = "*.wav", segment_s: float = SEGMENT_S, rate: int = 0, channels: int = 0, range_bytes: int = RANGE_BYTES, signals: bool = True) -> DataFrame:
    """Segments of ``segment_s`` seconds of the WAV files below a path or URI that pyarrow can open: path, sample_rate, channels, total_samples, start (in samples), left, right, error.

    The last segment of a file may be shorter; an empty file has none. Conditions
    on ``path`` and ``start`` decide what is read. ``rate`` and ``channels`` are what
    files must have (0: any; two channels at most). A file that is no such WAV file
    is a row with its path and an error, unless ``start`` is restricted.
    ``signals=False`` reads headers only. Stores that only Spark opens go through
    ``audio.read_wavs``.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSegments)
    options = {"pattern": pattern, "segment_s": segment_s, "rate": rate, "channels": channels, "range_bytes": range_bytes, "signals": str(signals).lower()}
    return spark.read.format("wav_segments").options(**options).load(path)
