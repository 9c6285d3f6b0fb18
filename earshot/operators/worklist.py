"""Work lists: pairing, stripes, what is left to do, completeness of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.columns import fresh_names
from earshot.storage import checkpointed


def numbered_rows(df: DataFrame, order: Sequence[str], out: str = "rn", *, first: int = 0, parts: int | None = None) -> DataFrame:
    """``df`` with consecutive numbers from ``first`` in the order of columns that identify a row.

    Rows are range-partitioned by the order and numbered within each range; a
    range begins where the ones before it end. No task holds all rows. The ranges
    come from a sample, so the partitioned rows are stored before they are counted.
    """
    spark, (part, before) = df.sparkSession, fresh_names(df, "_part", "_before")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    starts = counts.select(part, (F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(before))
    here = Window.partitionBy(part).orderBy(*order)
    return ranged.join(F.broadcast(starts), part).withColumn(out, (F.col(before) + F.row_number().over(here) - 1 + first).cast("long")).drop(part, before)


def stripe(df: DataFrame, order: Sequence[str], batch: int, batches: int, *, first: int = 0) -> DataFrame:
    """Every ``batches``-th row, beginning with number ``batch`` (counted from ``first``)."""
    (number,) = fresh_names(df, "_rn")
    return numbered_rows(df, order, number).where(F.col(number) % batches == batch - first).drop(number)


def sliced(df: DataFrame, order: Sequence[str], offset: int, limit: int = 0) -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them; 0 means the rest."""
    (number,) = fresh_names(df, "_rn")
    rows = numbered_rows(df, order, number).where(F.col(number) >= offset)
    return (rows.where(F.col(number) < offset + limit) if limit else rows).drop(number)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pairs_of(scenes: DataFrame, listeners_of: str, out: str = "listener") -> DataFrame:
    """A row for each listener in a scene's array; a scene without listeners has none."""
    return scenes.withColumn(out, F.explode(listeners_of)).drop(listeners_of)


def lookup(df: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a key without a match is an error, as a missing dictionary key is."""
    marked = dimension.withColumn("_found", F.lit(True))
    joined = df.join(marked, list(keys), "left")
    first = F.col(keys[0])
    checked = F.when(F.col("_found"), first).otherwise(F.raise_error(F.concat(F.lit(f"no match for {keys[0]} "), first.cast("string"))))
    return joined.withColumn(keys[0], checked).drop("_found")


def cycled(rows: DataFrame, order: Sequence[str], others: DataFrame, other_order: Sequence[str], *, out: str = "i") -> DataFrame:
    """Each row with one of ``others``, taken in turn and again from the first; their number is counted first."""
    n = others.count()
    left = numbered_rows(rows, order, out)
    right = numbered_rows(others, other_order, "_j")
    return left.join(right, F.pmod(F.col(out), F.lit(max(n, 1))) == F.col("_j")).drop("_j")


def once(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur once in both tables together."""
    return one.select(*keys).unionAll(two.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def set_check(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys in both, only in the first, only in the second."""
    sides = one.select(*keys).distinct().withColumn("_s", F.lit(1)).unionAll(two.select(*keys).distinct().withColumn("_s", F.lit(2)))
    found = sides.groupBy(*keys).agg(F.sum("_s").alias("_s"))
    count = lambda k: F.coalesce(F.sum((F.col("_s") == k).cast("long")), F.lit(0)).alias
    return found.agg(count(3)("in_both"), count(1)("only_first"), count(2)("only_second"))


def disjoint_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with ``n_train``: how many rows differ from it in every key.

    By inclusion and exclusion over the counts of equal keys, without comparing
    rows. Null keys equal each other.
    """
    names = list(keys)
    out = df.crossJoin(df.agg(F.count(F.lit(1)).alias("n_train")))  # one row
    for mask in range(1, 1 << len(names)):
        some = [c for i, c in enumerate(names) if mask >> i & 1]
        sign = -1 if len(some) % 2 else 1
        # coarse keys have few values and repeat on many rows; full keys repeat little, so counts move less than rows
        counts = df.groupBy(*some).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed({c: f"_{c}" for c in some})
        match = None
        for c in some:
            here = out[c].eqNullSafe(counts[f"_{c}"])
            match = here if match is None else match & here
        out = out.join(counts, match).withColumn("n_train", F.col("n_train") + sign * F.col("_n")).drop("_n", *[f"_{c}" for c in some])
    return out


def nearest_candidate(items: DataFrame, pool: DataFrame, *, equal: Sequence[str], need: str, have: str, order: Column, pick: Sequence[str]) -> DataFrame:
    """For each item, the first of the pool (by ``order``) with equal keys and ``have`` not below ``need``.

    A range join without pairs: as ``need`` rises, fewer of the pool qualify, so
    the answer depends on the needed value alone. Both sides meet in one window
    from the largest value down; the running least of the pool's order decides.
    """
    best = F.struct(order.alias("_o"), *[F.col(c) for c in pick])
    offers = pool.groupBy(*equal, F.col(have).cast("double").alias("_at")).agg(F.min(best).alias("_best"))
    asks = items.groupBy(*equal, F.col(need).cast("double").alias("_at")).agg(F.count(F.lit(1)).alias("_asked"))
    both = asks.join(offers, [*equal, "_at"], "full")
    down = Window.partitionBy(*equal).orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_best", F.min("_best").over(down)).where("_asked is not null")
    found = found.select(*equal, F.col("_at").alias("_need"), *[F.col(f"_best.{c}").alias(c) for c in pick])
    named = items.withColumn("_need", F.col(need).cast("double"))
    return named.join(found, [*equal, "_need"], "left").drop("_need")
