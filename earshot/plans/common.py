"""What the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Six decimals, without a negative zero: sums differ in their last digits by order."""
    return F.round(x, 6) + F.lit(0.0)


def q6(sql: str) -> str:
    """The same in SQL."""
    return f"(round({sql}, 6) + 0.0)"
