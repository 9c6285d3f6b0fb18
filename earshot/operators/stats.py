"""Score statistics. Degenerate input (no rows, one row, a constant) gives null, never an error or NaN."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.storage import checkpointed


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.avg((x - y) * (x - y)))


def mse(x: Column, y: Column) -> Column:
    return F.avg((x - y) * (x - y))


def mae(x: Column, y: Column) -> Column:
    return F.avg(F.abs(x - y))


def standard_error(x: Column, y: Column) -> Column:
    """Population standard deviation of the differences over the root of their number."""
    return F.stddev_pop(x - y) / F.sqrt(F.count(x - y))


def pearson(x: Column, y: Column, undefined: float | None = None) -> Column:
    """Correlation; ``undefined`` (null) for fewer than two pairs or a constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    cov = F.covar_pop(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((n > 1) & (spread > 0), F.try_divide(cov, spread)).otherwise(F.lit(undefined).cast("double"))


def score_set(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """n, rmse, mae, std_error and ncc for each group."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.count(a - b).alias("n"), rmse(a, b).alias("rmse"), mae(a, b).alias("mae"), standard_error(a, b).alias("std_error"), pearson(a, b).alias("ncc")
    )


def average_ranks(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``out``: the rank of ``value`` within its group, ties sharing their mean. Distinct values are ranked, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(out, below + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*by, value], "left") if by else df.join(ranks, value, "left")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), undefined: float | None = None) -> DataFrame:
    """Correlation of average ranks for each group, ``undefined`` where it has none; n counts whole pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(pairs, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_rx"), F.col("_ry"), undefined).alias("spearman"))


def _signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum over pairs of sign(dx) * sign(dy), weighted; by halving x and counting smaller and larger y of the lower half."""
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order].astype(float)
    total = 0.0
    parts = [(0, len(x))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < 2 or x[lo] == x[hi - 1]:
            continue
        middle = (lo + hi) // 2
        cut = int(np.searchsorted(x[lo:hi], x[middle], side="left")) + lo
        cut = cut if cut > lo else int(np.searchsorted(x[lo:hi], x[middle], side="right")) + lo
        left = np.argsort(y[lo:cut], kind="stable")
        ly, ln = y[lo:cut][left], np.append(0, np.cumsum(n[lo:cut][left]))
        below = ln[np.searchsorted(ly, y[cut:hi], side="left")]
        above = ln[-1] - ln[np.searchsorted(ly, y[cut:hi], side="right")]
        total += float((n[cut:hi] * (below - above)).sum())
        parts += [(lo, cut), (cut, hi)]
    return total


#: Distinct points of a strip of the plane, and the most strips each way; beyond, strips hold more.
STRIP_POINTS, MOST_STRIPS = 1 << 18, 512


def _strips(cuts: Sequence[float], value: str, out: str) -> tuple[Bucketizer, Column]:
    """A stage that finds the cut at or below ``value`` by halving, and the strip: an even number for a cut itself, an odd one for what lies between two."""
    stage = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol=out, handleInvalid="keep")
    at = F.col(out).cast("int")
    alone = F.get(F.lit([float(c) for c in cuts]), at - 1) == F.col(value)
    return stage, 2 * at + 1 - F.coalesce(alone, F.lit(False)).cast("int")


def kendall_tau_b(df: DataFrame, x: str, y: str, *, strip_points: int = STRIP_POINTS) -> DataFrame:
    """One row: n and tau_b, exact, without forming pairs.

    Equal pairs are counted first. The plane is cut into strips each way at
    quantiles, as many as it takes for ``strip_points`` distinct points in each; a
    value at a cut is a strip of its own, whose pairs tie, so that it may be as
    frequent as it likes. Pairs in different strips both ways follow from prefix
    sums over a table of strip counts. Pairs within an x strip, within a y strip,
    and within both, are counted by halving what a strip holds.
    """
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    points = checkpointed(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    strips = min(MOST_STRIPS, max(1, -(-points.count() // strip_points)))
    shares = [i / strips for i in range(1, strips)] or [0.5]
    cuts = points.agg(F.percentile_approx("x", shares).alias("x"), F.percentile_approx("y", shares).alias("y")).first()
    placed = points
    for c in ("x", "y"):
        stage, strip = _strips(sorted(set(cuts[c] or [0.0])), c, f"{c}_at")
        placed = stage.transform(placed).withColumn(f"{c}s", strip).drop(f"{c}_at")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [_signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy())]})

    # rows of a strip of one value tie
    many = lambda by: reduce(lambda a, b: a & b, [F.col(c) % 2 == 1 for c in by])
    inside = lambda by: placed.where(many(by)).groupBy(*by).applyInPandas(within, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    table = np.zeros((2 * MOST_STRIPS + 4, 2 * MOST_STRIPS + 4))
    for i, j, n in placed.groupBy("xs", "ys").agg(F.sum("n").alias("n")).collect():  # bounded by the numbers of strips
        table[i, j] = n
    upto = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    upto[1:, 1:] = table.cumsum(0).cumsum(1)
    below = upto[:-1, :-1]  # strips lower both ways
    above = upto[:-1, -1:] - upto[:-1, 1:]  # lower x, higher y
    across = float((table * (below - above)).sum())
    ties = lambda c: points.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("t"))
    n = points.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    all_pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    # each of these has one row
    joined = n.crossJoin(inside(["xs"]).withColumnRenamed("s", "sx")).crossJoin(inside(["ys"]).withColumnRenamed("s", "sy")).crossJoin(inside(["xs", "ys"]).withColumnRenamed("s", "sxy"))
    joined = joined.crossJoin(ties("x").withColumnRenamed("t", "tx")).crossJoin(ties("y").withColumnRenamed("t", "ty"))
    scale = F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty")))
    s = F.lit(across) + F.col("sx") + F.col("sy") - F.col("sxy")
    return joined.select("n", F.when(scale > 0, s / scale).alias("tau_b"))


def binned(value: Column, low: float, width: float, bins: int) -> Column:
    """Number of the right-closed bin (low + i * width, low + (i + 1) * width]; null outside."""
    i = (F.ceil((value - low) / width) - 1).cast("int")
    return F.when((i >= 0) & (i < bins), i)


def band_report(df: DataFrame, value: str, scores: Sequence[str], *, low: float, width: float, bins: int) -> DataFrame:
    """A row for every bin, empty ones too: n and the mean of each score."""
    spark = df.sparkSession
    cut = df.withColumn("band", binned(F.col(value), low, width, bins)).where("band is not null")
    means = cut.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(f"mean_{s}") for s in scores])
    every = spark.range(bins).select(F.col("id").cast("int").alias("band"))
    out = every.join(F.broadcast(means), "band", "left")  # one row a band
    return out.select("band", (F.lit(low) + F.col("band") * width).alias("above"), (F.lit(low) + (F.col("band") + 1) * width).alias("upto"), F.coalesce("n", F.lit(0)).alias("n"), *[f"mean_{s}" for s in scores])
