"""WAV files as signal columns and back, by Arrow batches."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class WavFormat(NamedTuple):
    kind: int
    channels: int
    rate: int
    width: int  # bits of a sample
    start: int  # byte of the first sample
    samples: int  # of a channel

    @property
    def step(self) -> int:
        return self.channels * self.width // 8


def wav_format(read: Callable[[int, int], bytes], size: int) -> WavFormat:
    """The format of a WAV file of ``size`` bytes, of which ``read`` gives so many from a place on; samples themselves are not read."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found, body = 12, (0, 0, 0, 0), None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            chunk = read(at + 8, min(length, 40))
            if len(chunk) < 16:
                raise ValueError("WAV format chunk too short")
            kind, channels, rate, _, _, width = struct.unpack_from("<HHIIHH", chunk)
            found = struct.unpack_from("<H", chunk, 24)[0] if kind == EXTENSIBLE and len(chunk) >= 26 else kind, channels, rate, width
        elif name == b"data":
            body = at + 8, min(length, size - at - 8)
        at += 8 + length + length % 2
    kind, channels, rate, width = found
    if body is None or not channels:
        raise ValueError("WAV file without format or data")
    if (kind, width) not in ((PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)):
        raise ValueError(f"WAV format {kind} of {width} bits")
    return WavFormat(kind, channels, rate, width, body[0], body[1] // (channels * width // 8))


def samples_of(form: WavFormat, body: bytes) -> np.ndarray:
    """Samples x channels, -1 to 1, of stored ones."""
    if form.kind == FLOAT:
        samples = np.frombuffer(body, f"<f{form.width // 8}").astype(float)
    elif form.width == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        samples = np.frombuffer(body, f"<i{form.width // 8}") / float(1 << (form.width - 1))
    return samples.reshape(-1, form.channels)


def decode_wav(data: bytes, offset: int = 0, n_samples: int | None = None) -> tuple[int, np.ndarray]:
    """Sample rate and samples (samples x channels, -1 to 1) of 16-, 24- or 32-bit PCM or float WAV; a seek past the end is an error."""
    form = wav_format(lambda at, n: data[at : at + n], len(data))
    if offset > form.samples:
        raise ValueError(f"offset {offset} beyond {form.samples} samples")
    last = form.samples if n_samples is None else min(offset + n_samples, form.samples)
    return form.rate, samples_of(form, data[form.start + offset * form.step : form.start + last * form.step])


def encode_wav(rate: int, samples: np.ndarray, *, floating: bool = True, strict: bool = False) -> bytes:
    """A WAV file of 32-bit floats or 16-bit PCM; PCM beyond full scale is clipped, or an error if ``strict``."""
    samples = samples if samples.ndim == 2 else samples[:, None]
    if floating:
        body, kind, width = samples.astype("<f4").tobytes(), FLOAT, 32
    else:
        if strict and (np.abs(samples) > 1).any():
            raise ValueError("signal beyond full scale")
        body, kind, width = np.clip(np.trunc(samples * 32768), -32768, 32767).astype("<i2").tobytes(), PCM, 16
    channels = samples.shape[1]
    step = channels * width // 8
    out = io.BytesIO()
    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, kind, channels, rate, rate * step, step, width, b"data", len(body)))
    out.write(body)
    return out.getvalue()


SIGNAL = "path string, sample_rate int, left array<double>, right array<double>"


def read_wavs(spark: SparkSession, path: str, *, glob: str = "*.wav", offset: int = 0, n_samples: int | None = None, channels: int | None = None) -> DataFrame:
    """Signals of WAV files: path, sample rate, left and right (mono: right is null).

    ``channels`` is how many a file must have. A file that cannot be read fails
    the query and names itself.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rate, samples = decode_wav(data, offset, n_samples)
                    if samples.shape[1] > 2 or (channels is not None and samples.shape[1] != channels):
                        raise ValueError(f"{samples.shape[1]} channels")
                except ValueError as error:
                    raise ValueError(f"{name}: {error}") from error
                sides = [samples[:, i].tolist() for i in range(samples.shape[1])] + [None]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), *(pa.array([s], pa.list_(pa.float64())) for s in sides[:2])], names=["path", "sample_rate", "left", "right"])

    return files.mapInArrow(run, SIGNAL)


def encoded(signals: DataFrame, *, floating: bool = True, strict: bool = False) -> DataFrame:
    """``path`` and ``content`` (a WAV file) of signals with the columns of ``read_wavs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rate, left, right in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                sides = [left] if right is None else [left, right]
                out.append(encode_wav(rate, np.array(sides, float).T, floating=floating, strict=strict))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return signals.select("path", "sample_rate", "left", "right").mapInArrow(run, "path string, content binary")
