"""Audiograms: ``struct<levels array<double>, frequencies array<double>>``, levels in dB HL at rising frequencies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.arrays import interpolated, mean

# The standard frequencies of audiograms, in Hz, and classes of hearing loss by their lower bounds in dB.
FREQUENCIES = (250, 500, 1000, 2000, 3000, 4000, 6000, 8000)
SEVERITY = (("SEVERE", 56.0), ("MODERATE", 35.0), ("MILD", 15.0))
NO_LOSS = "NOTHING"
#: Band of frequencies that decide the class.
SEVERITY_BAND = (2000.0, 8000.0)


def audiogram(levels: Column, frequencies: Column | Sequence[float] = FREQUENCIES) -> Column:
    """A checked audiogram: as many levels as frequencies, which rise strictly; else an error."""
    at = frequencies if isinstance(frequencies, Column) else F.array(*[F.lit(float(f)) for f in frequencies])
    rises = F.forall(F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1))), lambda i: (F.size(at) < 2) | (F.get(at, i - 1) < F.get(at, i)))
    made = F.struct(levels.alias("levels"), at.alias("frequencies"))
    return F.when(F.size(levels) != F.size(at), F.raise_error(F.lit("levels and frequencies differ in number"))).when(~rises, F.raise_error(F.lit("frequencies must rise"))).otherwise(made)


def severity(gram: Column) -> Column:
    """Class of the mean known level from 2 to 8 kHz; no level there counts as 0 dB."""
    low, high = SEVERITY_BAND
    pairs = F.arrays_zip(gram["levels"].alias("l"), gram["frequencies"].alias("f"))
    chosen = F.filter(pairs, lambda p: (p["f"] >= low) & (p["f"] <= high) & p["l"].isNotNull())
    loss = F.coalesce(mean(F.transform(chosen, lambda p: p["l"])), F.lit(0.0))
    label = F.lit(NO_LOSS)
    for name, bound in reversed(SEVERITY):
        label = F.when(loss > bound, F.lit(name)).otherwise(label)
    return F.when(gram.isNotNull(), label)


def has_frequencies(gram: Column, wanted: Sequence[float]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(float(f)) for f in wanted]), gram["frequencies"])) == 0


def level_at(gram: Column, frequency: Column) -> Column:
    """The level at a frequency, linear over log frequency, the end levels beyond the ends."""
    return interpolated(F.ln(frequency), F.transform(gram["frequencies"], F.ln), gram["levels"])


def resampled(gram: Column, frequencies: Sequence[float]) -> Column:
    """The audiogram at other frequencies."""
    at = F.array(*[F.lit(float(f)) for f in frequencies])
    return F.struct(F.transform(at, lambda f: level_at(gram, f)).alias("levels"), at.alias("frequencies"))


def average_loss(left: Column, right: Column, frequencies: Sequence[float] = (500, 1000, 2000, 4000)) -> Column:
    """The worse ear's mean level at the given frequencies."""
    return F.greatest(mean(resampled(left, frequencies)["levels"]), mean(resampled(right, frequencies)["levels"]))


# NAL-R prescription. Its six frequencies, and the bias of each in dB.
NALR_FREQUENCIES = (250, 500, 1000, 2000, 4000, 6000)
NALR_BIAS = (-17.0, -8.0, 1.0, -1.0, -2.0, -2.0)


def nalr_gains(levels: Column) -> Column:
    """Insertion gains in dB at the six frequencies, none below 0, for levels at them.

    The mean term is 0.05 of the levels at 500, 1000 and 2000 Hz together, and
    beyond 180 dB in all 9 + 0.116 of the excess. Without loss all gains are 0.
    """
    three = F.element_at(levels, 2) + F.element_at(levels, 3) + F.element_at(levels, 4)
    base = F.when(three <= 180, 0.05 * three).otherwise(9 + 0.116 * (three - 180))
    bias = F.array(*[F.lit(b) for b in NALR_BIAS])
    gains = F.zip_with(levels, bias, lambda level, b: F.greatest(base + 0.31 * level + b, F.lit(0.0)))
    return F.when(F.array_max(levels) > 0, gains).otherwise(F.transform(levels, lambda _: F.lit(0.0)))


# CAMFIT, linear. Intercepts in dB at their frequencies, the slope, and the centre frequencies of the nine bands.
CAMFIT_FREQUENCIES = (125, 250, 500, 750, 1000, 1500, 2000, 3000, 4000, 5000, 5005)
CAMFIT_INTERCEPTS = (-11, -10, -8, -6, 0, -1, 1, -1, 0, 1, 1)
CAMFIT_SLOPE = 0.48
CAMFIT_BANDS = (177, 297, 500, 841, 1414, 2378, 4000, 6727, 11314)


def camfit_intercepts(bands: Sequence[float] = CAMFIT_BANDS) -> list[float]:
    """Intercepts at the bands, linear over log frequency, the end values beyond the ends."""
    return np.interp(np.log(bands), np.log(CAMFIT_FREQUENCIES), CAMFIT_INTERCEPTS).tolist()


def camfit_gains(gram: Column, bands: Sequence[float] = CAMFIT_BANDS) -> Column:
    """Insertion gains of the bands in dB: none below 0, and all 0 where there is no loss."""
    at = resampled(gram, bands)["levels"]
    intercepts = F.array(*[F.lit(v) for v in camfit_intercepts(bands)])
    loss = F.exists(at, lambda v: v != 0)
    return F.zip_with(at, intercepts, lambda v, i: F.when(loss, F.greatest(v * CAMFIT_SLOPE + i, F.lit(0.0))).otherwise(F.lit(0.0)))


def limited_gains(gains: Column, level: Column, most: float = 100.0) -> Column:
    """Gains for an input level, lowered where the output would pass ``most`` dB."""
    return F.transform(gains, lambda g: F.least(g, F.lit(most) - level))


def band_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """What share of the range b the range a covers."""
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0)) / (b2 - b1)
