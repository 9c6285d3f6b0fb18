"""Signals as array columns: levels, gains, mixing, framing. All are JVM-side higher-order functions.

A null signal gives null; an empty one gives what each function states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is used within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doubles(signal: Column) -> Column:
    """The signal as an array of doubles."""
    return F.transform(signal, lambda x: x.cast("double"))


def total(signal: Column) -> Column:
    """Sum of a signal of doubles; 0 if empty."""
    return F.aggregate(signal, F.lit(ZERO), lambda a, x: a + x)


def energy(signal: Column) -> Column:
    """Sum of squares; 0 if empty."""
    return F.aggregate(signal, F.lit(ZERO), lambda a, x: a + x * x)


def rms(signal: Column) -> Column:
    """Root mean square; 0 if empty."""
    return F.when(F.size(signal) > 0, F.sqrt(energy(signal) / F.size(signal))).when(signal.isNotNull(), F.lit(ZERO))


def mean(signal: Column) -> Column:
    """Mean; null if empty."""
    return F.when(F.size(signal) > 0, total(signal) / F.size(signal))


def level_db(signal: Column) -> Column:
    """20 log10 of the RMS; null for silence."""
    return F.when(rms(signal) > 0, 20 * F.log10(rms(signal)))


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def scaled(signal: Column, gain: Column) -> Column:
    return F.transform(signal, lambda x: x * gain)


def clip_count(signal: Column, limit: float = 1.0) -> Column:
    """Samples beyond full scale."""
    return F.size(F.filter(signal, lambda x: F.abs(x) > limit))


def hard_clip(signal: Column, limit: float = 1.0) -> Column:
    return F.transform(signal, lambda x: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)))


def soft_clip(signal: Column) -> Column:
    """tanh, then full scale."""
    return hard_clip(F.transform(signal, F.tanh))


def to_pcm16(signal: Column) -> Column:
    """16-bit samples: scaled by 32768, clipped, cut towards zero."""
    return F.transform(signal, lambda x: F.greatest(F.least(x * 32768, F.lit(32767.0)), F.lit(-32768.0)).cast("smallint"))


def from_pcm16(signal: Column) -> Column:
    return F.transform(signal, lambda x: x.cast("double") / 32768)


def standardised(signal: Column) -> Column:
    """(x - mean) / population standard deviation; a constant signal gives zeros."""

    def scale(m: Column) -> Column:
        square = F.aggregate(signal, F.lit(ZERO), lambda a, x: a + (x - m) * (x - m))
        return let(F.sqrt(square / F.size(signal)), lambda d: F.transform(signal, lambda x: F.when(d > 0, (x - m) / d).otherwise(F.lit(ZERO))))

    return let(mean(signal), scale)


def padded(signal: Column, length: int | Column) -> Column:
    """Zeros behind up to ``length``; a longer signal is an error."""
    length = F.lit(length) if isinstance(length, int) else length
    fits = F.concat(signal, F.array_repeat(F.lit(ZERO), length - F.size(signal)))
    return F.when(F.size(signal) <= length, fits).otherwise(F.raise_error(F.lit("signal longer than the length to pad to")))


def padded_front(signal: Column, length: Column) -> Column:
    """Zeros in front up to ``length``; a longer signal stays."""
    return F.concat(F.array_repeat(F.lit(ZERO), F.greatest(length - F.size(signal), F.lit(0))), signal)


def added(one: Column, two: Column) -> Column:
    """Sum of two signals, the shorter counting as zeros beyond its end."""
    return F.zip_with(one, two, lambda x, y: F.coalesce(x, F.lit(ZERO)) + F.coalesce(y, F.lit(ZERO)))


def added_to_shorter(one: Column, two: Column) -> Column:
    """Sum of two signals, cut to the shorter."""
    length = F.least(F.size(one), F.size(two))
    return F.zip_with(F.slice(one, F.lit(1), length), F.slice(two, F.lit(1), length), lambda x, y: x + y)


def mixed(stems: Column) -> Column:
    """Sum of an array of signals."""
    return F.aggregate(stems, F.array().cast("array<double>"), added)


def dot(one: Column, two: Column) -> Column:
    return total(F.zip_with(one, two, lambda x, y: x * y))


def cosine(one: Column, two: Column) -> Column:
    """Cosine similarity; null if either is silent."""
    norm = F.sqrt(energy(one)) * F.sqrt(energy(two))
    return F.when(norm > 0, dot(one, two) / norm)


def si_snr(estimate: Column, target: Column, floor: float = 1e-8) -> Column:
    """Scale-invariant signal-to-noise ratio in dB, both signals centred; ``floor`` stands beside lengths, not energies."""

    def ratio(e: Column, t: Column) -> Column:
        scale = dot(e, t) / (energy(t) + floor)
        left = lambda k: F.sqrt(energy(F.zip_with(e, t, lambda x, y: x - y * k)))
        return let(scale, lambda k: 20 * F.log10(floor + F.abs(k) * F.sqrt(energy(t)) / (left(k) + floor)))

    centred = lambda s: let(mean(s), lambda m: F.transform(s, lambda x: x - m))
    return let(centred(estimate), lambda e: let(centred(target), lambda t: ratio(e, t)))


def snr_loss(estimate: Column, target: Column, softness: float = 1e-3, floor: float = 1e-8) -> Column:
    """Energy of the error over that of the target in dB, the error raised by ``softness`` times the target."""
    off = energy(F.zip_with(target, estimate, lambda t, e: t - e))
    return 10 * F.log10(off + softness * energy(target) + floor) - 10 * F.log10(energy(target) + floor)


def snr_db(target: Column, noise: Column) -> Column:
    """Ratio of RMS levels in dB; null if either is silent."""
    return F.when((rms(target) > 0) & (rms(noise) > 0), 20 * F.log10(rms(target) / rms(noise)))


def mixed_at_snr(target: Column, noise: Column, wanted_db: Column) -> Column:
    """Target plus noise scaled to the wanted ratio; silent noise adds nothing."""
    gain = F.coalesce(db_to_gain(snr_db(target, noise) - wanted_db), F.lit(ZERO))
    return let(gain, lambda g: F.zip_with(target, noise, lambda x, y: F.coalesce(x, F.lit(ZERO)) + F.coalesce(y, F.lit(ZERO)) * g))


def ramped(signal: Column, length: int) -> Column:
    """Raised-cosine fade in and out over ``length`` samples."""
    n = F.size(signal)

    def at(x: Column, i: Column) -> Column:
        near = F.least(i, n - 1 - i)
        return F.when(near < length, x * (F.lit(0.5) - F.cos(near * F.pi() / length) / 2)).otherwise(x)

    return F.transform(signal, at)


def frames(signal: Column, window: int, hop: int, *, last: bool = False) -> Column:
    """Overlapping frames from 0 in steps of ``hop``; the frame that ends with the signal only if ``last``."""
    most = F.size(signal) - window if last else F.size(signal) - window - 1
    starts = F.when(most >= 0, F.sequence(F.lit(0), most, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(signal, s + 1, F.lit(window)))


def first_argmax(signal: Column) -> Column:
    """Index of the first maximum, from 0; null if empty."""
    return F.when(F.size(signal) > 0, F.array_position(signal, F.array_max(signal)) - 1)


def peak_normalised(signal: Column) -> Column:
    """Scaled to a peak of 1; silence stays."""
    return let(F.array_max(F.transform(signal, F.abs)), lambda p: F.transform(signal, lambda x: F.when(p > 0, x / p).otherwise(x)))


def interpolated(x: Column, xs: Column, ys: Column, *, extrapolate: bool = False) -> Column:
    """Linear interpolation of the line through rising ``xs`` and ``ys`` at ``x``; beyond the ends the end values, or the end lines."""
    n = F.size(xs)
    below = F.size(F.filter(xs, lambda v: v <= x))
    at = F.greatest(F.least(below, n - 1), F.lit(1))
    x0, x1 = F.element_at(xs, at), F.element_at(xs, at + 1)
    y0, y1 = F.element_at(ys, at), F.element_at(ys, at + 1)
    line = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    inside = line if extrapolate else F.when(x <= F.element_at(xs, 1), F.element_at(ys, 1)).when(x >= F.element_at(xs, n), F.element_at(ys, n)).otherwise(line)
    return F.when(n == 1, F.element_at(ys, 1)).when(n > 1, inside)
