"""Short-time objective intelligibility from its published definition (Taal et al., 2011).

Both signals are cut to the frames in which the clean one is within 40 dB of its
loudest, analysed in fifteen third-octave bands at 10 kHz, and compared in
segments of thirty frames, the processed one scaled to the clean one's energy
and clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from earshot.kernels.filters import resample_poly

# Fixed values of the definition.
RATE, FRAME, FFT, BANDS, LOWEST, SEGMENT, RANGE_DB, CLIP_DB = 10_000, 256, 512, 15, 150.0, 30, 40.0, -15.0


def third_octaves(rate: int = RATE, fft: int = FFT, bands: int = BANDS, lowest: float = LOWEST) -> np.ndarray:
    """Bands x bins of zeros and ones: bins nearest to a band's edges bound it."""
    bins = np.linspace(0, rate, fft + 1)[: fft // 2 + 1]
    centre = lowest * 2 ** (np.arange(bands) / 3)
    edge = lambda f: np.argmin((bins[None, :] - f[:, None]) ** 2, axis=1)
    low, high = edge(centre * 2 ** (-1 / 6)), edge(centre * 2 ** (1 / 6))
    k = np.arange(len(bins))
    return ((k >= low[:, None]) & (k < high[:, None])).astype(float)


def _windowed(x: np.ndarray) -> np.ndarray:
    window = np.hanning(FRAME + 2)[1:-1]
    starts = np.arange(0, len(x) - FRAME, FRAME // 2)
    return x[starts[:, None] + np.arange(FRAME)] * window if len(starts) else np.zeros((0, FRAME))


def _joined(frames: np.ndarray) -> np.ndarray:
    hop = FRAME // 2
    out = np.zeros((len(frames) + 1) * hop)
    for half in (0, 1):
        part = frames[:, half * hop : (half + 1) * hop].ravel()
        out[half * hop : half * hop + len(part)] += part
    return out


def stoi(clean: np.ndarray, processed: np.ndarray, rate: int) -> float:
    """-1 to 1, higher is better; NaN where fewer than thirty frames are loud enough."""
    if len(clean) != len(processed):
        raise ValueError("signals differ in length")
    x, y = (resample_poly(np.asarray(s, float), RATE, rate) for s in (clean, processed))
    fx, fy = _windowed(x), _windowed(y)
    if not len(fx):
        return float("nan")
    level = 20 * np.log10(np.linalg.norm(fx, axis=1) + np.finfo(float).eps)
    loud = level > level.max() - RANGE_DB
    x, y = _joined(fx[loud]), _joined(fy[loud])
    bands = third_octaves()
    tob = lambda s: np.sqrt(np.einsum("bk,tk->bt", bands, np.abs(np.fft.rfft(_windowed(s), FFT)) ** 2))
    a, b = tob(x), tob(y)
    if a.shape[1] < SEGMENT:
        return float("nan")
    view = lambda s: np.lib.stride_tricks.sliding_window_view(s, SEGMENT, axis=1)
    a, b = view(a), view(b)
    eps = np.finfo(float).eps
    b = b * np.linalg.norm(a, axis=2, keepdims=True) / (np.linalg.norm(b, axis=2, keepdims=True) + eps)
    b = np.minimum(b, a * (1 + 10 ** (-CLIP_DB / 20)))
    centred = lambda s: s - s.mean(axis=2, keepdims=True)
    a, b = centred(a), centred(b)
    scale = (np.linalg.norm(a, axis=2) + eps) * (np.linalg.norm(b, axis=2) + eps)
    return float(((a * b).sum(axis=2) / scale).mean())


def scored(pairs: DataFrame, *, rate: int, clean_col: str = "clean", processed_col: str = "processed", out_col: str = "stoi") -> DataFrame:
    """``pairs`` with the intelligibility of the processed signal; null for null signals and where the measure is undefined."""
    at, to = pairs.columns.index(clean_col), pairs.columns.index(processed_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist(), strict=True):
                score = float("nan") if x is None or y is None else stoi(np.asarray(x), np.asarray(y), rate)
                found.append(None if np.isnan(score) else score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields] + [f"{out_col} double"])
    return pairs.mapInArrow(run, schema)
