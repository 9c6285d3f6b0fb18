"""Filter design and filtering from textbook definitions."""

from __future__ import annotations

import numpy as np


def lfilter(b, a, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Direct form II transposed along the last axis; returns the output and the final state."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    n = max(len(b), len(a))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    x = np.asarray(x, float)
    if n == 1:
        return b[0] * x, np.zeros((*x.shape[:-1], 0))
    z = np.zeros((*x.shape[:-1], n - 1)) if state is None else np.array(state, float)
    if not a[1:].any():  # no feedback: a convolution
        full = np.apply_along_axis(lambda row: np.convolve(row, b), -1, x)
        full[..., : n - 1] += z
        return full[..., : x.shape[-1]], full[..., x.shape[-1] :]
    out = np.empty_like(x)
    for i in range(x.shape[-1]):
        v = x[..., i]
        y = b[0] * v + z[..., 0]
        z[..., :-1] = z[..., 1:]
        z[..., -1] = 0
        z += b[1:] * v[..., None] - a[1:] * y[..., None]
        out[..., i] = y
    return out, z


def butter(order: int, cutoff: float, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth filter; the cutoff is a share of the Nyquist frequency."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warped = 2 * np.tan(np.pi * cutoff / 2)
    poles = poles * warped if kind == "low" else warped / poles
    z = (2 + poles) / (2 - poles)  # bilinear, sample rate 1
    a = np.real(np.poly(z))
    b = np.real(np.poly(np.full(order, -1.0 if kind == "low" else 1.0)))
    at = 1.0 if kind == "low" else -1.0
    return b * np.polyval(a, at) / np.polyval(b, at), a


def cheby2(order: int, stop_db: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital low-pass Chebyshev filter of the second kind; the stop band begins at the cutoff, a share of the Nyquist frequency."""
    k = np.arange(-order + 1, order, 2)
    rise = np.arcsinh(np.sqrt(10 ** (stop_db / 10) - 1)) / order
    unit = -np.exp(1j * np.pi * k / (2 * order))
    warped = 4 * np.tan(np.pi * cutoff / 2)
    poles = warped / (np.sinh(rise) * unit.real + 1j * np.cosh(rise) * unit.imag)
    zeros = warped * 1j / np.sin(k[k != 0] * np.pi / (2 * order))
    z = np.append((4 + zeros) / (4 - zeros), [-1] * (order - len(zeros)))
    a, b = np.real(np.poly((4 + poles) / (4 - poles))), np.real(np.poly(z))
    return b * a.sum() / b.sum(), a


def fir_band(taps: int, low: float, high: float) -> np.ndarray:
    """Hann-windowed ideal band from ``low`` to ``high`` (shares of Nyquist), of unit gain at its middle, at 0 for a low-pass and at 1 for a high-pass."""
    m = np.arange(taps) - (taps - 1) / 2
    h = (high * np.sinc(high * m) - low * np.sinc(low * m)) * np.hanning(taps)
    middle = 0 if low == 0 else 1 if high == 1 else (low + high) / 2
    return h / (h * np.cos(np.pi * m * middle)).sum()


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def fir_from_response(taps: int, frequencies, gains, points: int = 512) -> np.ndarray:
    """Linear-phase FIR of ``taps`` coefficients whose magnitude follows a polyline; frequencies rise from 0 to 1 (Nyquist).

    The response is laid on a grid piece by piece: a piece ends on the last grid
    point before its upper frequency, and the next begins on the point after.
    """
    frequencies, gains = np.asarray(frequencies, float), np.asarray(gains, float)
    points = points if taps < 1024 else 1 << int(np.ceil(np.log2(taps)))
    ends = np.fix(frequencies[1:] * (points + 1)).astype(int) - 1
    begins = np.append(0, ends[:-1] + 1)
    knots, values = np.column_stack([begins, ends]).ravel(), np.column_stack([gains[:-1], gains[1:]]).ravel()
    grid = np.arange(points + 1)
    turn = np.exp(-1j * np.pi * (taps - 1) / 2 * grid / points)
    return np.fft.irfft(np.interp(grid, knots, values) * turn)[:taps] * hamming(taps)


def resample_poly(x: np.ndarray, up: int, down: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Rational resampling through a Kaiser-windowed sinc."""
    g = np.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return np.array(x, float)
    wide = max(up, down)
    n = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(n / wide) / wide * np.kaiser(len(n), beta)
    h *= up / h.sum()
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    full = np.convolve(spread, h)[half * wide :]
    return full[: -(-len(x) * up // down) * down : down]
