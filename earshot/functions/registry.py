"""Functions for SQL, registered by name in a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from earshot.functions import text
from earshot.kernels import alignment, loudness, stoi


def _stoi(clean: pd.Series, processed: pd.Series, rate: pd.Series) -> pd.Series:
    found = [None if x is None or y is None else stoi.stoi(np.asarray(x), np.asarray(y), int(r)) for x, y, r in zip(clean, processed, rate, strict=True)]
    return pd.Series([None if v is None or np.isnan(v) else v for v in found], dtype="Float64")


def _loudness(signal: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else max(loudness.SILENCE, loudness.integrated_loudness(np.asarray(x), float(r))) for x, r in zip(signal, rate, strict=True)], dtype="Float64")


def _delay(reference: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([alignment.delay(np.asarray(x), np.asarray(y)) if x is not None and y is not None and len(x) and len(y) else None for x, y in zip(reference, other, strict=True)], dtype="Int32")


#: Name in SQL -> function over columns of a batch, and its type.
FUNCTIONS = {
    "align_words": (text._align_words, "hits int, substitutions int, deletions int, insertions int"),
    "numbers_spoken": (text._numbers_spoken, "string"),
    "stoi": (_stoi, "double"),
    "loudness": (_loudness, "double"),
    "signal_delay": (_delay, "int"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all of them known to the session's SQL; returns their names."""
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(function, kind))
    return list(FUNCTIONS)
