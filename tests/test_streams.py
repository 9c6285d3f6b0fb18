"""Streams in which chunks come in any order, and runs that are broken off."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.kernels.dynamics import Compressor
from earshot.streaming import chunks, results

SCHEMA = "signal_id string, chunk long, x array<double>"


def batches(spark, path, *frames):
    """A stream that reads a file of ``frames`` in each micro-batch."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
        time.sleep(0.01)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def gathered(spark, stream, name, until, seconds=90):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    end = time.time() + seconds
    try:
        while time.time() < end and query.exception() is None:
            rows = spark.table(name).collect()
            if until(rows):
                break
            time.sleep(0.3)
        assert query.exception() is None, query.exception()
    finally:
        query.stop()
    return sorted(spark.table(name).collect(), key=lambda r: (r.signal_id, r.chunk))


def test_chunks_in_any_order_over_three_batches(spark, tmp_path):
    x = {s: np.sin(np.arange(700) / (3 + i)) * 2 for i, s in enumerate("ab")}
    cut = [(s, i, x[s][i * 100 : (i + 1) * 100].tolist()) for s in x for i in range(7)]
    np.random.default_rng(3).shuffle(order := list(range(14)))
    rows = [cut[i] for i in order]
    stream = chunks.in_order(batches(spark, tmp_path / "in", rows[:5], [*rows[5:9], rows[0]], rows[9:]), chunks.Compressing(1000, threshold=0.5))
    got = gathered(spark, stream, "ordered", lambda r: len(r) >= 14)
    assert [(r.signal_id, r.chunk) for r in got] == [(s, i) for s in "ab" for i in range(7)]
    for s in x:
        assert np.allclose(np.concatenate([r.x for r in got if r.signal_id == s]), Compressor(1000, threshold=0.5).run(x[s])[0])


def test_a_chunk_that_does_not_come_is_given_up(spark, tmp_path):
    stream = chunks.in_order(batches(spark, tmp_path / "in", [("a", 0, [1.0]), ("a", 3, [4.0])], [("a", 2, [3.0])]), chunks.Fading(0), wait_ms=500)
    got = gathered(spark, stream, "given_up", lambda r: len(r) >= 3)
    assert [(r.chunk, list(r.x)) for r in got] == [(0, [1.0]), (2, [3.0]), (3, [4.0])]


def faded(parts, overlap):
    whole = np.zeros(sum(len(p) - overlap for p in parts) + overlap)
    at, rise = 0, np.linspace(0, 1, overlap)
    for i, p in enumerate(parts):
        p = p.copy()
        if i:
            p[:overlap] *= rise
        if i < len(parts) - 1:
            p[len(p) - overlap :] *= rise[::-1]
        whole[at : at + len(p)] += p
        at += len(p) - overlap
    return whole


def test_neighbours_fade_into_each_other(spark, tmp_path):
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=n) for n in (40, 50, 50, 30)]
    rows = [("a", i, p.tolist()) for i, p in enumerate(parts)]
    stream = chunks.in_order(batches(spark, tmp_path / "in", [rows[2], rows[1]], [rows[3]], [rows[0]]), chunks.Fading(10), wait_ms=500)
    got = gathered(spark, stream, "faded", lambda r: len(r) >= 5)
    assert np.allclose(np.concatenate([r.x for r in got]), faded(parts, 10))


def scored(spark, path, work, checkpoint, **how):
    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(str(work))
    return results.append_results(stream, lambda df: df.withColumn("score", F.col("v") * 2), str(path), ["k"], str(checkpoint), **how)


def test_a_run_killed_between_write_and_commit_adds_nothing_twice(spark, tmp_path):
    work, out, state = tmp_path / "work", tmp_path / "out", tmp_path / "state"
    for i, keys in enumerate((["a", "b", None], ["b", "c", "c", None], ["d"])):
        spark.createDataFrame([(k, float(i)) for k in keys], "k string, v double").coalesce(1).write.mode("append").parquet(str(work))
        time.sleep(0.05)

    def kill(number):
        if number == 1:
            raise RuntimeError("killed")

    query = scored(spark, out, work, state, written=kill)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    assert {r.batch for r in results.read_results(spark, str(out)).collect()} == {0, 1}  # written, not committed
    scored(spark, out, work, state).awaitTermination()
    rows = results.read_results(spark, str(out)).collect()
    assert sorted(map(str, (r.k for r in rows))) == ["None", "a", "b", "c", "d"]
    scored(spark, out, work, state).awaitTermination()  # nothing new
    assert results.read_results(spark, str(out)).count() == 5


def test_results_of_another_run_are_not_made_again(spark, tmp_path):
    work, out = tmp_path / "work", tmp_path / "out"
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double").write.parquet(str(work))
    scored(spark, out, work, tmp_path / "one").awaitTermination()
    before = results.read_results(spark, str(out)).count()
    spark.createDataFrame([("b", 9.0), ("c", 3.0)], "k string, v double").write.mode("append").parquet(str(work))
    scored(spark, out, work, tmp_path / "one").awaitTermination()
    rows = {r.k: r.score for r in results.read_results(spark, str(out)).collect()}
    assert before == 2 and rows == {"a": 2.0, "b": 4.0, "c": 6.0}
