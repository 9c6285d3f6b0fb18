"""Compressive CAMFIT gains and their noise gate as column expressions: tables of gains by band and input level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.arrays import let
from earshot.functions.audiogram import CAMFIT_BANDS, camfit_gains, limited_gains, resampled

# Centres of third octaves in Hz, and levels in dB there of average speech of 70 dB in all.
SPEECH_HZ = (63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000)
SPEECH_DB = (38.6, 43.5, 54.4, 57.7, 56.8, 60.2, 60.3, 59.0, 62.1, 62.1, 60.5, 56.8, 53.7, 53.0, 52.0, 48.7, 48.1, 46.8, 45.6, 44.5, 44.3, 43.7, 43.4, 41.3, 40.7)
# Thresholds of hearing in dB SPL (ISO 226:2003, ISO 389-7:2005, ends by extension) at their frequencies, and the least frequency asked for.
THRESHOLD_HZ = (0, 20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 14000, 16000, 18000, 20000)
THRESHOLD_DB = (80.0, 78.5, 68.7, 59.5, 51.1, 44.0, 37.5, 31.5, 26.5, 22.1, 17.9, 14.4, 11.4, 8.6, 6.2, 4.4, 3.0, 2.2, 2.4, 3.5, 1.7, -1.3, -4.2, -6.0, -5.4, -1.5, 6.0, 12.6, 13.9, 12.3, 18.4, 40.2, 73.2, 70.0)
LEAST_HZ = 50.0
# Edges of the nine bands in Hz, how far the faintest speech lies below the average, the least range that it is pressed into, and the table's input levels.
CAMFIT_EDGES = (1e-8, 229.2793, 385.3570, 648.4597, 1090.5, 1833.7, 3084.2, 5187.3, 8724.1, 10000001.0)
MINIMA_DB, LEAST_SPAN = 38.0, 13.0
INPUT_LEVELS = tuple(range(-10, 111))


def speech_levels(edges: Sequence[float] = CAMFIT_EDGES, bands: int | None = None) -> np.ndarray:
    """Levels of speech of 65 dB between consecutive ``edges``; of ``bands``, those beyond the last edge have 0 dB."""
    between = np.sqrt(np.multiply(SPEECH_HZ[:-1], SPEECH_HZ[1:], dtype=float))
    low, high = np.append(0.0, between), np.append(between, SPEECH_HZ[-1] * 2 ** (1 / 6))
    above, upto = (np.asarray(side, float)[:, None] for side in (edges[:-1], edges[1:]))
    share = np.clip(np.minimum(upto, high) - np.maximum(above, low), 0, None) / (high - low)
    known = 10 * np.log10(share @ 10 ** (np.asarray(SPEECH_DB) / 10)) - 5
    return np.append(known, np.zeros(max(0, (bands or 0) - len(known))))


def threshold_db(frequencies: Sequence[float]) -> np.ndarray:
    """dB SPL of 0 dB HL, linear over frequency; below 50 Hz as at 50 Hz, beyond the last value on its line."""
    at = np.maximum(np.asarray(frequencies, float), LEAST_HZ)
    steep = (THRESHOLD_DB[-1] - THRESHOLD_DB[-2]) / (THRESHOLD_HZ[-1] - THRESHOLD_HZ[-2])
    return np.interp(at, THRESHOLD_HZ, THRESHOLD_DB) + np.clip(at - THRESHOLD_HZ[-1], 0, None) * steep


def compressive_gains(
    gram: Column, levels: Sequence[float] = INPUT_LEVELS, *, bands: Sequence[float] = CAMFIT_BANDS, edges: Sequence[float] = CAMFIT_EDGES, rated_at: float | None = None, most: float = 100.0
) -> Column:
    """Gains in dB, an array by band of arrays by input level; null for a null audiogram.

    The faintest speech is raised to the threshold, average speech by the linear
    rule (by its gain for the input level ``rated_at``, if that is given, which
    must be one of ``levels``). Gains are never below 0 nor pass ``most`` dB of
    output, and all 0 where there is no loss.
    """
    if rated_at is not None and rated_at not in levels:
        raise ValueError(f"{rated_at} is none of the input levels")
    if len(edges) > len(bands) + 1:
        raise ValueError("more edges than the bands have")
    faint = speech_levels(edges, len(bands)) - MINIMA_DB
    linear = camfit_gains(gram, bands)
    if rated_at is not None:
        linear = limited_gains(linear, F.lit(float(rated_at)), most)
    fixed = F.array(*[F.struct(F.lit(float(q)).alias("faint"), F.lit(float(t)).alias("spl")) for q, t in zip(faint, threshold_db(bands), strict=True)])
    at = F.array(*[F.lit(float(v)) for v in levels])
    loss = F.exists(gram["levels"], lambda v: v != 0)

    def band(k: Column) -> Column:
        needed = k["heard"] + k["f"]["spl"] - k["f"]["faint"]
        ratio = F.greatest(F.lit(MINIMA_DB) / F.greatest(k["linear"] + F.lit(MINIMA_DB) - needed, F.lit(LEAST_SPAN)), F.lit(1.0))
        line = F.struct(k["f"]["faint"].alias("faint"), needed.alias("needed"), ratio.alias("ratio"))
        raised = lambda p, level: (level - p["faint"]) / p["ratio"] + p["faint"] + p["needed"] - level
        limited = lambda p, level: F.least(F.greatest(raised(p, level), F.lit(0.0)), F.lit(most) - level)
        return let(line, lambda p: F.transform(at, lambda level: F.when(loss, limited(p, level)).otherwise(F.lit(0.0))))

    rows = F.arrays_zip(resampled(gram, bands)["levels"].alias("heard"), linear.alias("linear"), fixed.alias("f"))
    return F.when(gram.isNotNull(), F.transform(rows, band))


def gated_gains(gains: Column, levels: Sequence[float] = INPUT_LEVELS, *, gate: float | Sequence[float] = 45.0, slope: float | Sequence[float] = 1.0, bands: int = len(CAMFIT_BANDS)) -> Column:
    """Gains by band and level with a noise gate: below ``gate`` dB the gain at the gate, less ``slope`` for each dB of input.

    ``gate`` and ``slope`` are one for all bands or one for each of ``bands``. The
    gain at the gate is linear between levels and on the end lines beyond them.
    """
    known = np.asarray(levels, float)
    at = F.array(*[F.lit(float(v)) for v in levels])
    gates, slopes = np.broadcast_to(gate, bands).astype(float), np.broadcast_to(slope, bands).astype(float)
    left = np.clip(np.searchsorted(known, gates, side="right") - 1, 0, max(0, len(known) - 2))
    right = np.minimum(left + 1, len(known) - 1)
    share = np.where(right > left, (gates - known[left]) / np.where(right > left, known[right] - known[left], 1.0), 0.0)
    each = lambda values, kind: F.array(*[F.lit(kind(v)) for v in values])
    doors = F.arrays_zip(each(gates, float).alias("gate"), each(slopes, float).alias("slope"), each(left, int).alias("left"), each(right, int).alias("right"), each(share, float).alias("share"))

    def band(row: Column, d: Column) -> Column:
        edge = F.get(row, d["left"]) + (F.get(row, d["right"]) - F.get(row, d["left"])) * d["share"]
        return let(edge, lambda g: F.zip_with(row, at, lambda v, level: F.when(level < d["gate"], (level - d["gate"]) * d["slope"] + g).otherwise(v)))

    return F.zip_with(gains, doors, band)
