"""Alignment of signals: delay by cross-correlation, and dynamic time warping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def delay(reference: np.ndarray, other: np.ndarray, most: int | None = None) -> int:
    """By how many samples ``other`` lags ``reference``: the first maximum of the cross-correlation, within ``most`` either way."""
    n = len(reference) + len(other) - 1
    size = 1 << (n - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(other, size) * np.conj(np.fft.rfft(reference, size)), size)
    lags = np.arange(-(len(reference) - 1), len(other))
    if most is not None:
        lags = lags[np.abs(lags) <= most]
    return int(lags[np.argmax(cross[lags % size])])


def aligned(reference: np.ndarray, other: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both signals without the delay between them, cut to the shorter."""
    d = delay(reference, other, most)
    one, two = reference[max(-d, 0) :], other[max(d, 0) :]
    n = min(len(one), len(two))
    return one[:n], two[:n]


def dtw(one: np.ndarray, two: np.ndarray) -> float:
    """Least sum of absolute differences along a monotone path, by anti-diagonals; infinite if either is empty."""
    n, m = len(one), len(two)
    if not n or not m:
        return float("inf")
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n, s + 1))
        now = np.full(n + 1, np.inf)
        # entry i + 1 holds cell (i, s - i); its neighbours lie on the two diagonals before
        least = np.minimum(np.minimum(last[i], last[i + 1]), before[i]) if s else np.zeros(1)
        now[i + 1] = np.abs(one[i] - two[s - i]) + least
        before, last = last, now
    return float(last[n])


def compared(pairs: DataFrame, *, one_col: str = "x", two_col: str = "y", most: int | None = None) -> DataFrame:
    """``pairs`` with ``lag`` and ``dtw`` (per sample of both); null for null or empty signals."""
    at, to = pairs.columns.index(one_col), pairs.columns.index(two_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lags, costs = [], []
            for x, y in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist(), strict=True):
                good = bool(x) and bool(y)
                lags.append(delay(np.asarray(x), np.asarray(y), most) if good else None)
                costs.append(dtw(np.asarray(x), np.asarray(y)) / (len(x) + len(y)) if good else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lags, pa.int32()), pa.array(costs, pa.float64())], names=[*batch.schema.names, "lag", "dtw"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields] + ["lag int, dtw double"])
    return pairs.mapInArrow(run, schema)
