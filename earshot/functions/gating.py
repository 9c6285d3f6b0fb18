"""Levels of what is loud enough: windows of a signal above a threshold, fixed or at a share of the windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.arrays import energy, let

#: The least threshold in dB, how far below it the floor of window levels lies, and the bins of their histogram.
LEAST_DB, FLOOR_DB, BINS = -80.0, 30.0, 140


def first_threshold(mean_square: Column, relative_db: float) -> Column:
    """``relative_db`` above the level of the whole signal, ``LEAST_DB`` at least."""
    return F.greatest(20 * F.log10(F.sqrt(mean_square)) + relative_db, F.lit(LEAST_DB))


def window_db(mean_square: Column, threshold: Column) -> Column:
    """Level of a window over a floor that the threshold gives."""
    return 10 * F.log10(F.pow(F.lit(10.0), (threshold - FLOOR_DB) / 10) + mean_square)


def edge(low: Column, high: Column, i: Column, bins: int = BINS) -> Column:
    """Edge ``i`` of equal bins from ``low`` to ``high``; half a dB to each side of a single value."""
    single = low == high
    start, end = F.when(single, low - 0.5).otherwise(low), F.when(single, high + 0.5).otherwise(high)
    return F.when(i >= bins, end).otherwise(start + i * ((end - start) / bins))


def bin_of(x: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """The bin of ``x``: from its edge up to the next one, the last with its end."""
    start, width = edge(low, high, F.lit(0), bins), edge(low, high, F.lit(bins), bins) - edge(low, high, F.lit(0), bins)
    near = F.greatest(F.least(F.floor((x - start) / width * bins), F.lit(bins - 1)), F.lit(0))
    return (near - (x < edge(low, high, near, bins)).cast("int") + ((x >= edge(low, high, near + 1, bins)) & (near < bins - 1)).cast("int")).cast("int")


def share_threshold(low: Column, high: Column, bin_: Column, bins: int = BINS) -> Column:
    """The threshold for a share of windows: the lower edge of the bin in which what is to be left out ends, the second edge at least."""
    return edge(low, high, F.greatest(bin_, F.lit(1)), bins)


def gated(signal: Column, window: int, relative_db: float, share: float | None = None) -> Column:
    """RMS over the loud windows of a signal, and which these are.

    Windows of ``window`` samples follow each other; what is left at the end is
    none. They count if their level reaches ``relative_db`` above the signal's, or
    with ``share`` the level that about so many per cent of them reach. Fields:
    ``rms`` (null if no window counts), ``threshold_db``, ``relative_db`` (threshold
    over the RMS), ``active`` (per cent of the samples), ``windows`` (their numbers
    from 0). An empty signal gives a null.
    """
    count = F.floor(F.size(signal) / window).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    squares = F.transform(places, lambda i: energy(F.slice(signal, i * window + 1, F.lit(window))) / window)

    def levels(e: Column) -> Column:
        return let(first_threshold(energy(signal) / F.size(signal), relative_db), lambda t: let(F.transform(e, lambda v: window_db(v, t)), lambda db: chosen(e, t, db)))

    def chosen(e: Column, fixed: Column, db: Column) -> Column:
        if share is None:
            return told(e, fixed, db)
        out = F.floor(F.lit(100 - share) * F.size(db) / 100).cast("int")
        rank = F.get(F.array_sort(db), F.least(out, F.size(db) - 1))
        low, high = F.array_min(db), F.array_max(db)
        return let(F.coalesce(share_threshold(low, high, bin_of(rank, low, high)), fixed), lambda t: told(e, t, db))

    def told(e: Column, threshold: Column, db: Column) -> Column:
        loud = F.filter(F.transform(db, lambda d, i: F.when(d >= threshold, i)), lambda i: i.isNotNull())
        return let(loud, lambda k: let(F.when(F.size(k) > 0, F.sqrt(F.aggregate(k, F.lit(0.0), lambda a, i: a + F.get(e, i)) / F.size(k))), lambda r: result(k, r, threshold)))

    def result(loud: Column, level: Column, threshold: Column) -> Column:
        return F.struct(level.alias("rms"), threshold.alias("threshold_db"), (threshold - 20 * F.log10(level)).alias("relative_db"), (F.lit(100.0) * window * F.size(loud) / F.size(signal)).alias("active"), loud.alias("windows"))

    return F.when(F.size(signal) > 0, let(squares, levels))
