"""Loud windows against a plain histogram over each signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import gating
from earshot.operators import framing


def brute(x, window, relative_db, share):
    with np.errstate(divide="ignore"):
        threshold = max(20 * np.log10(np.sqrt(np.mean(x**2))) + relative_db, -80)
    windows = x[: len(x) // window * window].reshape(-1, window)
    squares = (windows**2).mean(axis=1)
    db = 10 * np.log10(10 ** ((threshold - 30) / 10) + squares)
    if share is not None and len(db):
        counts, levels = np.histogram(db, 140)
        left_out, below = 0, 0
        for n in counts:
            left_out += n
            if left_out > (100 - share) * len(db) / 100:
                break
            below += 1
        threshold = levels[max(1, below)]
    loud = np.flatnonzero(db >= threshold)
    rms = np.sqrt(squares[loud].mean()) if len(loud) else None
    return rms, threshold, 100 * len(loud) * window / len(x), loud.tolist()


def sounds():
    rng = np.random.default_rng(4)
    burst = np.where(np.arange(500) % 100 < 30, 1.0, 0.01) * rng.normal(size=500)
    return {"burst": burst, "noise": rng.normal(size=333), "quiet": 1e-6 * rng.normal(size=100), "silent": np.zeros(60), "short": np.array([0.5, 0.5]), "steady": np.full(80, 0.25), "half": np.r_[np.zeros(50), np.ones(50)]}


CASES = [(10, 0.0, None), (10, -12.0, None), (7, -12.0, 20.0), (10, 0.0, 50.0), (10, -12.0, 100.0), (25, -6.0, 1.0)]


@pytest.mark.parametrize(("window", "relative_db", "share"), CASES)
def test_arrays_and_long_form(spark, window, relative_db, share):
    named = sounds()
    arrays = spark.createDataFrame([(k, x.tolist()) for k, x in named.items()], "k string, x array<double>")
    got = {r.k: r.g for r in arrays.select("k", gating.gated(F.col("x"), window, relative_db, share).alias("g")).collect()}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in named.items() for i, v in enumerate(x)], "k string, i long, x double").repartition(7)
    long = {r.k: r for r in framing.gated_levels(rows, ["k"], "i", "x", window=window, relative_db=relative_db, share=share).collect()}
    assert set(got) == set(long) == set(named)
    for k, x in named.items():
        rms, threshold, active, loud = brute(x, window, relative_db, share)
        for r in (got[k], long[k]):
            assert r.rms == (None if rms is None else pytest.approx(rms, rel=1e-9))
            assert (r.threshold_db, r.active) == (pytest.approx(threshold, rel=1e-9), pytest.approx(active))
            assert r.relative_db == (pytest.approx(threshold - 20 * np.log10(rms), abs=1e-9) if rms else None)
        assert got[k].windows == loud and long[k].n == len(x)


def test_odd_signals(spark):
    arrays = spark.createDataFrame([(1, []), (2, None)], "k int, x array<double>")
    assert [r.g for r in arrays.select(gating.gated(F.col("x"), 10, 0.0).alias("g")).collect()] == [None, None]
    rows = spark.createDataFrame([(None, i, 1.0 if i < 40 else None) for i in range(60)], "k int, i long, x double")
    (r,) = framing.gated_levels(rows, ["k"], "i", "x", window=10, relative_db=0.0).collect()
    assert (r.k, r.n, r.rms, r.active) == (None, 60, 1.0, pytest.approx(100 * 40 / 60))
    assert framing.gated_levels(rows.where("i < 0"), ["k"], "i", "x", window=10, relative_db=0.0, share=50).count() == 0


def test_bins_are_those_of_a_histogram(spark):
    x = np.r_[np.linspace(0, 1.4, 141), np.random.default_rng(0).uniform(0, 1.4, 500)]
    counts, _ = np.histogram(x, 140)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select(gating.bin_of(F.col("x"), F.lit(0.0), F.lit(1.4)).alias("b"))
    got = {r.b: r["count"] for r in rows.groupBy("b").count().collect()}
    assert [got.get(i, 0) for i in range(140)] == counts.tolist()
