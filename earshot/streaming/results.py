"""Runs that append results as work comes in, and can be broken off at any point."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results so far, with the ``batch`` that added each."""
    return spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*")


def append_results(work: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], checkpoint: str, *, written: Callable[[int], None] | None = None, **trigger: object) -> StreamingQuery:
    """Starts a stream that appends ``make`` of new work to ``path``, a key once.

    Every micro-batch has a folder of its own, written whole or not at all, and
    the keys in the others are the ledger: what they hold is not made again. A
    batch that was written but not committed is made again after a restart with
    the same ``checkpoint`` and replaces itself, so that it adds nothing. Of equal
    keys within a batch one row counts; null keys equal each other. ``make`` keeps
    the keys. ``written`` is called with a batch's number once it is written.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates(list(keys))
        if _exists(spark, path):
            ledger = read_results(spark, path).where(F.col(BATCH) != number).select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
            match = [todo[k].eqNullSafe(ledger[f"_done_{k}"]) for k in keys]
            todo = todo.join(ledger, match, "left_anti")
        make(todo).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
        if written:
            written(number)

    return work.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
