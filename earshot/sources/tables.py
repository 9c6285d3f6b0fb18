"""JSON, JSONL, CSV and room files as DataFrames, and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.audiogram import audiogram
from earshot.sources import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record a line; a line that does not parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one array of records each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_map(spark: SparkSession, path: str, kind: str, key: str = "id", value: str = "value") -> DataFrame:
    """Files that hold one object keyed by id: a row for each key."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias(key, value))


def read_listeners(spark: SparkSession, path: str) -> DataFrame:
    """Listeners with checked audiograms of both ears."""
    rows = read_json_map(spark, path, schemas.LISTENER_JSON, "listener")
    ear = lambda side: audiogram(F.col(f"value.audiogram_levels_{side}"), F.col("value.audiogram_cfs"))
    return rows.select("listener", ear("l").alias("left"), ear("r").alias("right"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Scene-listener pairs of an object of lists."""
    return read_json_map(spark, path, schemas.PAIRS_JSON, "scene").select("scene", F.explode("value").alias("listener"))


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, *, glob: str | None = None) -> DataFrame:
    """CSV with a header line, whose names give way to the schema's."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST")
    return (reader.option("pathGlobFilter", glob) if glob else reader).csv(paths if isinstance(paths, str) else list(paths))


def read_scores(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scores with the key ``scene_listener``."""
    return read_csv(spark, paths, schemas.SCORE).withColumn("key", F.concat_ws("_", "scene", "listener"))


def batch_paths(folder: str, stem: str, batches: int) -> list[str]:
    """Result files of a run in batches, counted from 1."""
    return [f"{folder}/{stem}_{i}-{batches}.csv" for i in range(1, batches + 1)]


def write_results(df: DataFrame, path: str, columns: Sequence[str], *, append: bool = False) -> None:
    """Chosen columns in order, with a header; a missing column is an error, and so is an existing path unless appending."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise KeyError(f"results lack columns {lost}")
    df.select(*columns).write.option("header", True).mode("append" if append else "errorifexists").csv(path)


def rounded(values: Column, digits: int = 4) -> Column:
    """An array of doubles rounded for a JSON sink."""
    return F.transform(values, lambda v: F.round(v, digits))


def write_scenes(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scenes as JSON lines, the room by its name."""
    df.withColumn("room", F.col("room.name")).write.mode(mode).json(path)


def read_rooms(spark: SparkSession, path: str, glob: str = "*.rpf") -> DataFrame:
    """Room geometry of INI-like text files: id, and each file's name, positions and view vectors.

    A vector is a list of numbers in parentheses after its key; a missing key gives null.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    named = lambda key: F.regexp_extract("value", rf"(?m)^\s*{key}\s*=\s*(.*?);?\s*$", 1)

    def vector(key: str) -> Column:
        raw = F.regexp_replace(named(key), r"[\[\](){};\s]", "")
        return F.when(raw != "", F.transform(F.split(raw, ","), lambda x: x.cast("double")))

    return files.select(
        F.regexp_extract("path", r"R\d{5}", 0).alias("room"),
        F.nullif(named("ProjectName"), F.lit("")).alias("project"),
        *[vector(k).alias(k) for k in ("sourcePositions", "sourceViewVectors", "receiverPositions", "receiverViewVectors")],
    )


def unfinished(work: DataFrame, spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """Work whose keys are not among the results written so far; all of it, if there are none yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return work
    return work.join(read_csv(spark, path, schema).select(*keys).distinct(), list(keys), "left_anti")
