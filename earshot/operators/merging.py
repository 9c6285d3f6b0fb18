"""Rows by key: the last of each, merged tables, levels within a group, draws with replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.columns import fresh_names, same_keys
from earshot.functions.levels import keyed_number


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the greatest by ``order``; ties are broken by all other columns. Nothing is sorted."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("last"))
    return kept.select(*keys, "last.row.*").select(*df.columns)


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of both; a key in both has its row of ``right``."""
    return right.unionByName(left.join(right.select(*keys).distinct(), list(keys), "left_anti"))


def equalised(df: DataFrame, by: Sequence[str], level: Column, signal: str, out: str) -> DataFrame:
    """Signals raised to the greatest ``level`` of their group, rows of a null group by theirs; a silent one stays."""
    top, gain, *names = fresh_names(df, "_top", "_gain", *(f"_of_{c}" for c in by))
    tops = df.groupBy(*by).agg(F.max(level).alias(top)).withColumnsRenamed(dict(zip(by, names, strict=True)))
    raised = F.when(level > 0, F.col(top) / level).otherwise(F.lit(1.0))
    joined = df.join(tops, same_keys(df, tops, list(zip(by, names, strict=True)))).withColumn(gain, raised)
    return joined.withColumn(out, F.transform(signal, lambda v: v * F.col(gain))).drop(top, gain, *names)


def drawn(numbered: DataFrame, count: int, draws: int, seed: int, number: str = "n") -> DataFrame:
    """``draws`` rows with replacement of the ``count`` rows numbered from 0, each with its ``draw``."""
    spark = numbered.sparkSession
    wanted = spark.range(draws).select(F.col("id").alias("draw"), keyed_number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), max(count, 1)).alias(number))
    return wanted.join(numbered, number)
