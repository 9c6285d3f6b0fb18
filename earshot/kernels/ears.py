"""Measures of two ears: each ear's score and the better one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.audiogram import NALR_FREQUENCIES, resampled
from earshot.kernels import haspi, quality


def hearing_levels(gram: Column) -> Column:
    """Levels at the ear model's six frequencies, linear over log frequency."""
    return resampled(gram, NALR_FREQUENCIES)["levels"]


def better_ear(
    pairs: DataFrame,
    measure: str,
    *,
    rate: float,
    seed_col: str,
    left: tuple[str, str, str] = ("reference_left", "processed_left", "levels_left"),
    right: tuple[str, str, str] = ("reference_right", "processed_right", "levels_right"),
    level: float = 100.0,
    networks: haspi.Networks | None = None,
) -> DataFrame:
    """``pairs`` with ``<measure>_left``, ``<measure>_right`` and ``<measure>``, the greater of the two.

    ``left`` and ``right`` name an ear's reference, processed signal and levels at
    the six frequencies (``hearing_levels``). ``measure`` is "haspi", which needs
    ``networks``, or one of ``quality.MEASURES``. An ear without a score does not
    count; without any the score is null.
    """
    if measure == "haspi" and networks is None:
        raise ValueError("haspi needs the weights of its networks")
    for side, columns in (("left", left), ("right", right)):
        if measure == "haspi":
            pairs = haspi.scored(pairs, rate=rate, seed_col=seed_col, networks=networks, columns=columns, level=level).drop("modulation")
        else:
            pairs = quality.scored(pairs, measure, rate=rate, seed_col=seed_col, columns=columns, level=level)
        pairs = pairs.withColumnRenamed(measure, f"{measure}_{side}")
    return pairs.withColumn(measure, F.greatest(f"{measure}_left", f"{measure}_right"))
