"""Loudness by ITU-R BS.1770: K-weighting, gated blocks, and gains that bring a signal to a target."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.arrays import scaled
from earshot.kernels.filters import lfilter

# Fixed values of the standard: offset, absolute gate in LUFS, relative gate in LU, block and its step in seconds.
OFFSET, ABSOLUTE, RELATIVE, BLOCK_S, STEP_S = -0.691, -70.0, -10.0, 0.4, 0.1
#: What stands for the loudness of silence where a number is needed.
SILENCE = -80.0


def _shelf(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The standard's high shelf (1681.97 Hz, 4 dB, Q 0.7072), for any rate."""
    k, q, gain = np.tan(np.pi * 1681.974450955533 / rate), 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    half = gain**0.4996667741545416
    a0 = 1 + k / q + k * k
    return np.array([gain + half * k / q + k * k, 2 * (k * k - gain), gain - half * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


def _high_pass(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The standard's high-pass (38.14 Hz, Q 0.5003)."""
    k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
    a0 = 1 + k / q + k * k
    return np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


def integrated_loudness(channels: np.ndarray, rate: float) -> float:
    """LUFS of channels x samples; -inf where no block passes the gates or the signal is shorter than a block."""
    x = np.atleast_2d(np.asarray(channels, float))
    block, step = int(BLOCK_S * rate), int(STEP_S * rate)
    if x.shape[1] < block:
        return float("-inf")
    y = lfilter(*_high_pass(rate), lfilter(*_shelf(rate), x)[0])[0]
    total = np.cumsum(np.pad(y**2, ((0, 0), (1, 0))), axis=1)
    starts = np.arange(0, x.shape[1] - block + 1, step)
    power = ((total[:, starts + block] - total[:, starts]) / block).sum(axis=0)
    level = lambda p: OFFSET + 10 * np.log10(np.maximum(p, 1e-30))
    power = power[level(power) > ABSOLUTE]
    if not len(power):
        return float("-inf")
    power = power[level(power) > level(power.mean()) + RELATIVE]
    return float(level(power.mean())) if len(power) else float("-inf")


def with_loudness(signals: DataFrame, *, rate: float, left: str = "left", right: str | None = "right", out_col: str = "lufs") -> DataFrame:
    """``signals`` with their loudness; ``SILENCE`` where it is minus infinity, null where the left signal is."""
    at, to = signals.columns.index(left), signals.columns.index(right) if right else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                sides = [batch.column(c)[i].as_py() for c in (at, to) if c is not None]
                sides = [s for s in sides if s is not None]
                found.append(max(SILENCE, integrated_loudness(np.array(sides), rate)) if sides else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema.fields] + [f"{out_col} double"])
    return signals.mapInArrow(run, schema)


def to_loudness(signal: Column, lufs: Column, target: Column) -> Column:
    """The signal brought from its loudness to a target."""
    return scaled(signal, F.pow(F.lit(10.0), (target - lufs) / 20))
