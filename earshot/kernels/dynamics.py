"""Compressors: gains that follow a signal's level with separate times of attack and release."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from earshot.kernels.filters import butter, lfilter


@dataclass
class Compressor:
    """A gain that moves to ``rms * attenuation + (1 - attenuation) * threshold`` above the threshold, to 1 below.

    Each sample takes it the share ``1 / (time * rate)`` of the way. ``attack`` and
    ``release`` are such times in ms, ``rms_ms`` is the window of the level.
    """

    rate: float
    attack: float = 5.0
    release: float = 20.0
    threshold: float = 1.0
    attenuation: float = 0.0001
    rms_ms: float = 200.0
    makeup: float = 1.0

    @property
    def window(self) -> int:
        return max(1, int(self.rate * self.rms_ms / 1000))

    def levels(self, x: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """RMS over the window that ends at each sample; ``tail`` is what came before."""
        square = np.concatenate([tail, x]) ** 2
        total = np.cumsum(np.append(0.0, square))
        n = self.window
        return np.sqrt(np.maximum(total[n + 1 :] - total[1:-n], 0) / n + 1e-8)

    def run(self, x: np.ndarray, gain: float = 1.0, tail: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
        """The compressed signal, and the gain and tail to carry on with."""
        tail = np.zeros(self.window) if tail is None else tail
        rms = self.levels(x, tail)
        loud = rms > self.threshold
        aim = np.where(loud, rms * self.attenuation + (1 - self.attenuation) * self.threshold, 1.0)
        share = np.where(loud, 1000 / (self.attack * self.rate), 1000 / (self.release * self.rate))
        gains = np.empty(len(x))
        for i, (keep, step) in enumerate(zip((1 - share).tolist(), (share * aim).tolist(), strict=True)):
            gain = keep * gain + step
            gains[i] = gain
        return x * gains * self.makeup, float(gain), np.concatenate([tail, x])[-self.window :]


@dataclass
class KneeCompressor:
    """A static curve in dB with a soft knee, smoothed by attack when its gain falls and release when it rises."""

    rate: float
    threshold: float = -20.0
    ratio: float = 4.0
    attack: float = 10.0
    release: float = 100.0
    knee: float = 6.0
    makeup_db: float = 0.0

    def static(self, level: np.ndarray) -> np.ndarray:
        """Level out for level in, both in dB."""
        over = level - self.threshold
        within = level + (1 / self.ratio - 1) * (over + self.knee / 2) ** 2 / (2 * max(self.knee, 1e-12))
        return np.where(2 * over < -self.knee, level, np.where(2 * np.abs(over) <= self.knee, within, self.threshold + over / self.ratio))

    def run(self, x: np.ndarray) -> np.ndarray:
        level = np.maximum(20 * np.log10(np.maximum(np.abs(x), 1e-12)), -120)
        cut = level - self.static(level)
        fast, slow = (np.exp(-1 / (t * self.rate / 1000)) for t in (self.attack, self.release))
        held, out = 0.0, np.empty(len(x))
        for i, c in enumerate(cut):
            keep = fast if c > held else slow
            held = keep * held + (1 - keep) * c
            out[i] = held
        return x * 10 ** ((self.makeup_db - out) / 20)


def crossover(x: np.ndarray, cutoffs: Sequence[float], rate: float) -> np.ndarray:
    """Bands (fourth-order Linkwitz-Riley, bands x samples) whose sum is an all-pass of the signal.

    Each band goes through the all-pass of every split above it, so that phases agree.
    """
    bands, rest = [], np.asarray(x, float)
    twice = lambda y, f, kind: lfilter(*butter(2, 2 * f / rate, kind), lfilter(*butter(2, 2 * f / rate, kind), y)[0])[0]
    for i, f in enumerate(cutoffs):
        low, rest = twice(rest, f, "low"), twice(rest, f, "high")
        for g in cutoffs[i + 1 :]:
            low = twice(low, g, "low") + twice(low, g, "high")
        bands.append(low)
    return np.stack([*bands, rest])


def multiband(x: np.ndarray, cutoffs: Sequence[float], rate: float, units: Sequence[KneeCompressor]) -> np.ndarray:
    """Bands through a compressor each, summed."""
    return sum(unit.run(band) for unit, band in zip(units, crossover(x, cutoffs, rate), strict=True))


def compressed(signals: DataFrame, *, rate: float, signal_col: str = "x", out_col: str = "compressed", **settings: float) -> DataFrame:
    """``signals`` with the compressor's output and its last ``gain``; a null signal gives nulls, an empty one an empty one."""
    at = signals.columns.index(signal_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = Compressor(rate, **settings)
        for batch in batches:
            found = [None if x is None else unit.run(np.asarray(x, float)) for x in batch.column(at).to_pylist()]
            out = pa.array([None if f is None else f[0].tolist() for f in found], pa.list_(pa.float64()))
            gain = pa.array([None if f is None else f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out, gain], names=[*batch.schema.names, out_col, "gain"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema.fields] + [f"{out_col} array<double>, gain double"])
    return signals.mapInArrow(run, schema)
