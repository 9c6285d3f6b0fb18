"""NAL-R: from an audiogram's gains to a filter, and the filter applied to signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from earshot.functions.audiogram import NALR_BIAS, NALR_FREQUENCIES
from earshot.kernels.filters import fir_from_response


def nalr_filter(gains_db: np.ndarray | None, rate: float, taps: int = 220) -> np.ndarray:
    """``taps`` + 1 coefficients whose magnitude follows the gains, linear in dB between the six frequencies; null gains are a pure delay."""
    if gains_db is None:
        out = np.zeros(taps + 1)
        out[taps // 2] = 1
        return out
    at = np.concatenate([[0], NALR_FREQUENCIES, [rate / 2]])
    grid = np.linspace(0, 1, taps + 1)
    db = np.interp(grid * rate / 2, at, np.concatenate([gains_db[:1], gains_db, gains_db[-1:]]))
    return fir_from_response(taps + 1, grid, 10 ** (db / 20))


def nalr_gains_of(levels: np.ndarray) -> np.ndarray | None:
    """The prescription's gains for levels at its six frequencies; None without loss."""
    if levels.max() <= 0:
        return None
    three = levels[1:4].sum()
    base = 0.05 * three if three <= 180 else 9 + 0.116 * (three - 180)
    return np.maximum(base + 0.31 * levels + NALR_BIAS, 0)


def amplified(signals: DataFrame, *, rate: float, signal_col: str = "x", gains_col: str = "gains", out_col: str = "amplified", taps: int = 220) -> DataFrame:
    """``signals`` through the filters of their gains (full convolution); equal gains share a filter. Null in, null out."""
    x_at, g_at = signals.columns.index(signal_col), signals.columns.index(gains_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, np.ndarray] = {}
            out = []
            for x, gains in zip(batch.column(x_at).to_pylist(), batch.column(g_at).to_pylist(), strict=True):
                if x is None or gains is None:
                    out.append(None)
                    continue
                key = tuple(gains)
                if key not in known:
                    known[key] = nalr_filter(np.array(gains) if any(gains) else None, rate, taps)
                out.append(np.convolve(np.asarray(x, float), known[key]).tolist() if len(x) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, out_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema.fields] + [f"{out_col} array<double>"])
    return signals.mapInArrow(run, schema)
