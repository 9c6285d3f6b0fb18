"""Windows over signals longer than one task should hold."""

import random

import pytest
from pyspark.sql import functions as F

from earshot.operators import framing, merging, splits, worklist

SCHEMA = "signal string, at long, part int, x double"


def signals(sizes, seed=0):
    rng = random.Random(seed)
    rows = [(s, i // 2, i % 2, rng.uniform(-1, 1) if i % 7 else None) for s, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


def by_signal(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[{"one": 700}, {"a": 300, None: 40, "b": 41, "c": 1, "d": 90}], ids=["one signal", "several"])
def long_rows(request, monkeypatch):
    monkeypatch.setattr(framing, "LONGEST", 40)
    return signals(request.param)


def test_samples_are_numbered(spark, long_rows):
    got = framing.sample_index(spark.createDataFrame(long_rows, SCHEMA), ["signal"], ["at", "part"]).collect()
    want = {tuple(r): i for rows in by_signal(long_rows).values() for i, r in enumerate(rows)}
    assert {tuple(r)[:4]: r.i for r in got} == want and len(got) == len(long_rows)


@pytest.mark.parametrize("n", [1, 7, 60])
def test_moving_levels_and_delays(spark, long_rows, n):
    frame = spark.createDataFrame(long_rows, SCHEMA)
    levels = {tuple(r)[:4]: r.moving_rms for r in framing.moving_rms(frame, ["signal"], ["at", "part"], "x", n).collect()}
    late = {tuple(r)[:4]: r.late for r in framing.shifted(frame, ["signal"], ["at", "part"], "x", n, "late").collect()}
    assert len(levels) == len(late) == len(long_rows)
    for rows in by_signal(long_rows).values():
        x = [r[3] or 0.0 for r in rows]
        for i, r in enumerate(rows):
            assert levels[r] == pytest.approx((sum(v * v for v in x[max(0, i - n + 1) : i + 1]) / n + 1e-8) ** 0.5)
            assert late[r] == (rows[i - n][3] if i >= n else 0.0)


def test_no_task_holds_a_long_signal(spark, long_rows):
    """Every window's rows: a block and what it looks back on."""
    frame = spark.createDataFrame(long_rows, SCHEMA)
    sizes = framing.over_last(frame, ["signal"], ["at", "part"], 7, lambda w: F.count(F.lit(1)).over(w.rowsBetween(-(2**31), 2**31 - 1)), "n").agg(F.max("n")).first()[0]
    assert sizes <= 40 + 7


def test_short_signals_are_not_cut(spark):
    rows = signals({"a": 30, "b": 5})
    got = framing.shifted(spark.createDataFrame(rows, SCHEMA), ["signal"], ["at", "part"], "x", 2, "late", default=None)
    assert "_block" not in got._jdf.queryExecution().toString() and got.count() == 35
    assert framing.sample_index(spark.createDataFrame([], SCHEMA), ["signal"], ["at"]).count() == 0


def test_columns_named_as_inner_ones_stay(spark, monkeypatch):
    monkeypatch.setattr(framing, "LONGEST", 10)
    names = ["_part", "_before", "_here", "_at", "_block", "_own", "_rn", "_draw", "_top", "_gain", "_of_g"]
    rows = spark.range(50).select("id", (F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), *[(F.col("id") + i).alias(n) for i, n in enumerate(names)])
    made = [
        framing.moving_rms(rows, ["g"], ["id"], "x", 3),
        framing.sample_index(rows, ["g"], ["id"]),
        worklist.numbered_rows(rows, ["id"]),
        worklist.stripe(rows, ["id"], 1, 2),
        worklist.sliced(rows, ["id"], 10, 20),
        splits.sample_per_group(rows, ["g"], "id", 5, 1),
        splits.hold_out(rows, "_draw", 0.5, 1),
        merging.equalised(rows.withColumn("s", F.array("x")), ["g"], F.col("x"), "s", "y"),
    ]
    for out in made:
        got = out.collect()
        assert got and all(r[n] == r["id"] + i for r in got for i, n in enumerate(names))


def test_rows_of_a_null_group_are_equalised(spark):
    rows = spark.createDataFrame([(1, "a", [1.0], 1.0), (2, "a", [2.0], 2.0), (3, None, [3.0], 3.0), (4, None, [6.0], 6.0), (5, None, [0.0], 0.0)], "id long, g string, x array<double>, level double")
    got = merging.equalised(rows, ["g"], F.col("level"), "x", "y").collect()
    assert {(r.id, r.y[0]) for r in got} == {(1, 2.0), (2, 2.0), (3, 6.0), (4, 6.0), (5, 0.0)}
