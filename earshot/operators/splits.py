"""Seeded shuffles, samples and splits, the same in every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.columns import fresh_names
from earshot.functions.draws import open_unit, weighted_order
from earshot.functions.keys import seeded_order
from earshot.operators.worklist import numbered_rows
from earshot.storage import checkpointed


def sample_per_group(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of each group without replacement (all, if fewer), with their seeded ``rank`` from 1.

    Spark keeps only ``k`` rows a group and task before the shuffle.
    """
    (draw,) = fresh_names(df, "_draw")
    drawn = Window.partitionBy(*by).orderBy(draw, key)
    return df.withColumn(draw, seeded_order(seed, F.col(key))).withColumn("rank", F.row_number().over(drawn)).where(F.col("rank") <= k).drop(draw)


def weighted_sample(df: DataFrame, by: Sequence[str], key: str, weight: str, k: int, seed: int, out: str = "rank") -> DataFrame:
    """``k`` rows of each group without replacement, drawn by weight, with their ``out`` from 1 in the order drawn.

    Rows whose weight is null or not above 0 are not drawn; a group with fewer
    others gives all of those. Spark keeps only ``k`` rows a group and task before
    the shuffle.
    """
    (draw,) = fresh_names(df, "_draw")
    order = weighted_order(open_unit(F.col(key), "weighted", seed), F.col(weight).cast("double"))
    rows = df.withColumn(draw, order).where(F.col(draw).isNotNull())
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(draw, key))).where(F.col(out) <= k).drop(draw)


def hold_out(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``held_out``: true for the floor of ``share`` of the distinct keys, drawn by seed."""
    draw, number = fresh_names(df.select(key), "_draw", "_rn")
    keys = df.select(key).distinct().withColumn(draw, seeded_order(seed, F.col(key)))
    n = keys.count()
    drawn = numbered_rows(keys, [draw, key], number).select(key, (F.col(number) < int(n * share)).alias("held_out"))
    return df.join(drawn, key)


def prompt_split(df: DataFrame, group: str, target: int, seed: int) -> DataFrame:
    """Groups in seeded order go to train until it has ``target`` rows: ``split`` is train where the rows before are fewer.

    The running sum goes over groups in ranges of their order, like row numbers.
    """
    draw, part, earlier = fresh_names(df.select(group), "_draw", "_part", "_before")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn(draw, seeded_order(seed, F.col(group)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(sizes.repartitionByRange(parts, draw, group).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(part).agg(F.sum("n").alias("total"))
    starts = totals.select(part, F.coalesce(F.sum("total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(earlier))
    here = Window.partitionBy(part).orderBy(draw, group).rowsBetween(Window.unboundedPreceding, -1)
    reached = ranged.join(F.broadcast(starts), part).withColumn("before", F.col(earlier) + F.coalesce(F.sum("n").over(here), F.lit(0)))
    return reached.select(group, "n", F.col("before").cast("long").alias("before"), F.when(F.col("before") < target, "train").otherwise("valid").alias("split"))
