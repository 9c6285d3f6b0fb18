"""Segments of envelopes against plain windows, and against the kernel's arithmetic where all frames are active."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions.segments import EPS, segment_match


def brute(x, y, n, clip_db, mask):
    total, weight = 0.0, 0.0
    for i in range(len(x) - n + 1):
        a, b, m = x[i : i + n], y[i : i + n], mask[i : i + n]
        b = b * np.linalg.norm(a * m) / (np.linalg.norm(b * m) + EPS)
        if clip_db is not None:
            b = np.minimum(b, a * (1 + 10 ** (-clip_db / 20)))
        a, b = (v - (v * m).sum() / (m.sum() + EPS) for v in (a, b))
        total += (a * b * m).sum() / ((np.linalg.norm(a * m) + EPS) * (np.linalg.norm(b * m) + EPS))
        weight += m.mean()
    return total / (weight + EPS) if weight else None


@pytest.mark.parametrize(("n", "clip_db", "some"), [(30, -15.0, True), (30, -15.0, False), (5, None, True), (40, -15.0, True)])
def test_by_windows(spark, n, clip_db, some):
    rng = np.random.default_rng(n)
    cases = [(i, np.abs(rng.normal(size=40)), np.abs(rng.normal(size=40)), (rng.uniform(size=40) < (0.6 if some else 2)).astype(float)) for i in range(6)]
    frame = spark.createDataFrame([(i, x.tolist(), y.tolist(), m.tolist()) for i, x, y, m in cases], "i int, x array<double>, y array<double>, m array<double>")
    got = {r.i: r.s for r in frame.select("i", segment_match(F.col("x"), F.col("y"), n, clip_db=clip_db, active=F.col("m") if some else None).alias("s")).collect()}
    for i, x, y, m in cases:
        assert got[i] == pytest.approx(brute(x, y, n, clip_db, m), abs=1e-9)


def test_edges(spark):
    rows = [(1, [1.0] * 4, [1.0] * 4, [1.0] * 4), (2, [], [], []), (3, None, [1.0], [1.0]), (4, [1.0, 2.0, 3.0] * 3, [1.0, 2.0, 3.0] * 2, [1.0] * 9), (5, [1.0, 2.0] * 4, [1.0, 2.0] * 4, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "i int, x array<double>, y array<double>, m array<double>")
    got = {r.i: r.s for r in frame.select("i", segment_match(F.col("x"), F.col("y"), 5, active=F.col("m")).alias("s")).collect()}
    assert got[1] is got[2] is got[3] is got[5] is None and got[4] == pytest.approx(1.0, abs=1e-6)
