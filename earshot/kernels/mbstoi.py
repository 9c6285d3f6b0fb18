"""Modified binaural short-time objective intelligibility (Andersen et al., 2018).

The better of two routes counts in each band and segment: an equalisation-
cancellation stage, searched over interaural delays and level differences with
the published jitter, and the better ear alone. Expectations over the grid are
bilinear in a few inner products of centred band spectra, so each segment needs
ten of those, and the grid is one broadcast expression over all segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Settings:
    """Fixed values of the published measure."""

    rate: float = 10_000.0
    frame: int = 256
    fft: int = 512
    bands: int = 15
    lowest: float = 150.0
    segment: int = 30
    range_db: float = 40.0
    tau: float = 1e-3
    gamma_db: float = 20.0
    taus: int = 100
    gammas: int = 40
    sigma_delta: float = 65e-6
    sigma_epsilon: float = 1.5
    alpha_db: float = 13.0
    tau_0: float = 1.6e-3
    exponent: float = 1.6


def resample_fft(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples of the band-limited periodic signal through ``x``; the bin at the lower Nyquist frequency is shared."""
    spectrum, low = np.fft.rfft(x), min(n, len(x))
    out = np.zeros(n // 2 + 1, complex)
    half = low // 2 + 1
    out[:half] = spectrum[:half]
    if low % 2 == 0 and n != len(x):
        out[low // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * (n / len(x))


def _frames(x: np.ndarray, size: int) -> np.ndarray:
    starts = np.arange(0, len(x) - size, size // 2)
    return x[starts[:, None] + np.arange(size)] * np.hanning(size + 2)[1:-1]


def _without_silence(signals: list[np.ndarray], size: int, range_db: float) -> list[np.ndarray]:
    """Signals joined again from the frames in which either clean ear (the first two) is within the range of its loudest."""
    cut = [_frames(s, size) for s in signals]
    level = [20 * np.log10(np.linalg.norm(f, axis=1) + np.finfo(float).eps) for f in cut[:2]]
    keep = (level[0] > level[0].max() - range_db) | (level[1] > level[1].max() - range_db)
    out = []
    for f in cut:
        joined = np.zeros((int(keep.sum()) + 1, size // 2))
        joined[:-1] += f[keep, : size // 2]
        joined[1:] += f[keep, size // 2 :]
        out.append(joined.ravel())
    return out


def _edges(s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.arange(s.fft // 2 + 1) * s.rate / s.fft
    centre = s.lowest * 2 ** (np.arange(s.bands) / 3)
    nearest = lambda f: np.argmin(np.abs(bins[None, :] - f[:, None]), axis=1)
    return centre, nearest(centre * 2 ** (-1 / 6)), nearest(centre * 2 ** (1 / 6))


def mbstoi(left: np.ndarray, right: np.ndarray, left_noisy: np.ndarray, right_noisy: np.ndarray, rate: float, s: Settings = Settings()) -> float:
    """Mean over bands and segments; NaN where fewer frames than a segment are loud enough."""
    signals = [np.asarray(x, float) for x in (left, right, left_noisy, right_noisy)]
    if rate != s.rate:
        n = int(len(signals[0]) * (s.rate / rate) + 1)
        signals = [resample_fft(x, n) for x in signals]
    if len(signals[0]) <= s.frame:
        return float("nan")
    signals = _without_silence(signals, s.frame, s.range_db)
    xl, xr, yl, yr = (np.fft.rfft(_frames(x, s.frame)[:, : s.fft], s.fft) for x in signals)
    count = len(xl) - s.segment + 1
    if count < 1:
        return float("nan")
    tau, gamma_db = np.linspace(-s.tau, s.tau, s.taus), np.linspace(-s.gamma_db, s.gamma_db, s.gammas)
    epsilon = np.sqrt(2) * s.sigma_epsilon * (1 + (np.abs(gamma_db) / s.alpha_db) ** s.exponent) / 20
    delta = np.sqrt(2) * s.sigma_delta * (1 + np.abs(tau) / s.tau_0)
    up = 10 ** (gamma_db / 20)
    level_jitter = np.exp(2 * np.log(10) ** 2 * epsilon**2)
    scores = np.zeros((s.bands, count))
    for band, (centre, first, last) in enumerate(zip(*_edges(s), strict=True)):
        omega = 2 * np.pi * centre
        turn = np.exp(-1j * omega * tau)
        both_jitter = np.exp(0.5 * (np.log(10) ** 2 * epsilon[None, :] ** 2 - omega**2 * delta[:, None] ** 2))
        time_jitter = np.exp(-2 * omega**2 * delta**2)
        a, b, c, d = (z[:, first:last] for z in (xl, xr, yl, yr))

        def windows(values: np.ndarray) -> np.ndarray:
            cut = np.lib.stride_tricks.sliding_window_view(values, s.segment)
            return cut - cut.mean(axis=1, keepdims=True)

        clean = [windows(v) for v in ((np.abs(a) ** 2).sum(1), (np.abs(b) ** 2).sum(1), (b.conj() * a).sum(1))]
        noisy = [windows(v) for v in ((np.abs(c) ** 2).sum(1), (np.abs(d) ** 2).sum(1), (d.conj() * c).sum(1))]
        inner = lambda u, v: (u * v).sum(axis=1)[:, None, None]

        def expected(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
            """Segments x delays x level differences."""
            (l1, r1, p1), (l2, r2, p2) = one, two
            level = (up**2 * inner(l1, l2) + up**-2 * inner(r1, r2)) * level_jitter + inner(l1, r2) + inner(r1, l2)
            cross = lambda q1, q2: np.real((inner(q1, p2) + inner(q2, p1)) * turn[None, :, None])
            mixed = 2 * both_jitter * (up * cross(l1, l2) + cross(r1, r2) / up)
            phase = 2 * (np.real(inner(p1, p2.conj())) + time_jitter[:, None] * np.real(inner(p1, p2) * turn[None, :, None] ** 2))
            return level - mixed + phase

        for at in range(0, count, 64):
            some = slice(at, at + 64)
            x, y = [v[some] for v in clean], [v[some] for v in noisy]
            exx, eyy, exy = (expected(*pair).reshape(len(x[0]), -1, s.gammas) for pair in ((x, x), (y, y), (x, y)))
            flat = lambda e: e.transpose(0, 2, 1).reshape(len(e), -1)
            exx, eyy, exy = flat(exx), flat(eyy), flat(exy)
            # a product of exactly zero anywhere makes the segment worth -1
            none = (exx * eyy == 0).any(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = exx / eyy
                best = np.argmax(ratio, axis=1)
                row = np.arange(len(best))
                cancelled = np.where(none, -1, exy[row, best] / np.sqrt(exx[row, best] * eyy[row, best]))
                power = np.where(none, 0, ratio[row, best])
                ear = [(x[i] ** 2).sum(1) / (y[i] ** 2).sum(1) for i in (0, 1)]
                fit = [np.nan_to_num((x[i] * y[i]).sum(1) / np.sqrt((x[i] ** 2).sum(1) * (y[i] ** 2).sum(1)), nan=0, posinf=0, neginf=0) for i in (0, 1)]
            better = np.where(ear[0] > ear[1], fit[0], fit[1])
            use = np.maximum(*ear) > power
            use &= np.arange(at, at + len(use)) < count - 1  # the last segment goes by cancellation alone
            scores[band, some] = np.where(use, better, cancelled)
    return float(scores.mean())


def scored(pairs: DataFrame, *, rate: float, columns: tuple[str, str, str, str] = ("left", "right", "left_noisy", "right_noisy"), out_col: str = "mbstoi", s: Settings = Settings()) -> DataFrame:
    """``pairs`` with the measure of their four signals; null for null signals and where it is undefined."""
    places = [pairs.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for signals in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                score = float("nan") if any(x is None for x in signals) else mbstoi(*map(np.asarray, signals), rate, s)
                found.append(None if np.isnan(score) else score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields] + [f"{out_col} double"])
    return pairs.mapInArrow(run, schema)
