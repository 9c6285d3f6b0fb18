"""Names of columns that operators add for their own use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    """Whether columns of two tables are equal pair by pair, nulls too."""
    match = None
    for a, b in keys:
        here = left[a].eqNullSafe(right[b])
        match = here if match is None else match & here
    return match
