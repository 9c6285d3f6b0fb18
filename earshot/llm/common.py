"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earshot.columns import fresh_names
from earshot.storage import checkpointed

__all__ = ["checkpointed", "chunks", "crc32_of_id", "fresh_names", "hot_among", "hot_parts", "join_by_parts", "local_table", "ragged", "release", "salted_join", "schema_with", "table", "with_columns", "with_parts"]

#: Characters of text that a Python worker turns into arrays at once; a longer text is taken whole.
CHUNK_CHARS = 1 << 19


#: A key with this many rows or more is dealt to several tasks; no more than ``MOST_HOT`` such keys are broadcast.
HOT_ROWS, MOST_HOT = 1024, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, columns: dict[str, pa.Array], kinds: StructType | None = None) -> DataFrame:
    """A small table of the driver's, columns cast as ``kinds`` has them. It is read from Arrow: a list of rows would start Python workers of another kind, which stay."""
    made = spark.createDataFrame(pa.table(columns))
    return made.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in kinds}) if kinds else made


def trim() -> None:
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let go of what finished rounds have left: Spark drops broadcasts, shuffles and checkpoints once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id's decimal text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of ``texts`` (null as empty) of about ``most`` characters, with the index of their first.

    After the last, memory that arrays have left goes back to the system: a
    worker lives on after its task.
    """
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held
    trim()


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns added by position, so that clashing names do no harm."""
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def schema_with(df: DataFrame, ddl: str) -> str:
    """The schema of ``df`` followed by the columns of ``ddl``; a clash of names is an error that names the column."""
    new = [part.strip().split()[0].lower() for part in ddl.split(",")]
    clash = [c for c in df.columns if c.lower() in new]
    if clash:
        raise ValueError(f"the input already has columns {clash}; rename them first")
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [ddl])


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose row i holds the next ``counts[i]`` of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def hot_parts(rows: DataFrame, key: str) -> DataFrame | None:
    """``key`` and ``_parts`` of the ``MOST_HOT`` most frequent keys of ``HOT_ROWS`` rows or more; null if there are none.

    Rows are counted before they are shuffled. Any other key has fewer rows than
    ``HOT_ROWS``, or no more than the ``MOST_HOT``-th part of all.
    """
    return hot_among(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def hot_among(counts: DataFrame, key: str) -> DataFrame | None:
    """``hot_parts`` where rows are counted: ``key`` and ``n``."""
    hot = counts.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), key).limit(MOST_HOT).select(key, "n").collect()
    if not hot:
        return None
    parts = [min(4096, -(-2 * r[1] // HOT_ROWS)) for r in hot]
    return local_table(counts.sparkSession, {key: pa.array([r[0] for r in hot]), "_parts": pa.array(parts, pa.int32())}, counts.select(key).schema)


def with_parts(rows: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """``rows`` with ``_parts``: how many tasks share the rows of their key."""
    if hot is None:
        return rows.withColumn("_parts", F.lit(1))
    return rows.join(F.broadcast(hot), key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def salted_join(rows: DataFrame, one: DataFrame, key: str, by: str | Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``one`` (at most a row for each value of ``key``), the rows of hot keys dealt to several tasks by ``by``; inner or left."""
    return join_by_parts(rows, one, hot_parts(rows, key), key, by, how)


def join_by_parts(rows: DataFrame, one: DataFrame, hot: DataFrame | None, key: str, by: str | Column, how: str = "inner") -> DataFrame:
    """``salted_join`` where ``hot_parts`` of ``rows`` are known."""
    if hot is None:
        return rows.join(one, key, how)
    left = with_parts(rows, hot, key).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    right = with_parts(one, hot, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
