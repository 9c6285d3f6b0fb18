import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.operators import framing, splits, stats, worklist


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scores(spark):
    row = stats.score_set(frame(spark, [(1.0, -1.0), (-1.0, 1.0)], "x double, y double"), "x", "y").first()
    assert row.std_error == pytest.approx(np.sqrt(2)) and row.rmse == 2 and row.ncc == pytest.approx(-1)


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)], [(None, 1.0), (2.0, None)]])
def test_correlation_of_degenerate_input_is_null(spark, rows):
    assert stats.score_set(frame(spark, rows, "x double, y double"), "x", "y").first().ncc is None


def tau(x, y):
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    scale = np.sqrt((sx**2).sum() * (sy**2).sum())
    return (sx * sy).sum() / scale if scale else None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9)), min_size=0, max_size=60))
def test_kendall(spark, pairs):
    got = stats.kendall_tau_b(frame(spark, pairs, "x int, y int"), "x", "y", strip_points=12).first()
    wanted = tau([p[0] for p in pairs], [p[1] for p in pairs]) if pairs else None
    assert got.n == len(pairs) and (got.tau_b is None if wanted is None else got.tau_b == pytest.approx(wanted))


@pytest.mark.parametrize("y", ["id % 2", "if(id % 3 = 0, 7, id % 1000)", "hash(id, 3)", "5"])
def test_kendall_of_frequent_values_holds_no_more_than_a_strip(spark, monkeypatch, y):
    count = stats._signed_pairs

    def seen(x, y, n):
        if len(x) > 3000:
            raise AssertionError(f"{len(x)} points")
        return count(x, y, n)

    monkeypatch.setattr(stats, "_signed_pairs", seen)
    rows = spark.range(20_000).selectExpr("hash(id) % 3000 AS x", f"{y} AS y")
    got = stats.kendall_tau_b(rows, "x", "y", strip_points=1000).first()
    local = rows.groupBy("x", "y").count().toPandas()
    points = [local[c].to_numpy(float) for c in ("x", "y", "count")]
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    total = 20_000 * 19_999 / 2
    scale = ((total - pairs(local.groupby("x")["count"].sum())) * (total - pairs(local.groupby("y")["count"].sum()))) ** 0.5
    assert got.n == 20_000 and (got.tau_b == pytest.approx(count(*points) / scale, abs=1e-12) if scale else got.tau_b is None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(1, 3)), max_size=25))
def test_signed_pairs(points):
    x, y, n = (np.array([p[i] for p in points], float) for i in range(3))
    wanted = sum(n[i] * n[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    assert stats._signed_pairs(x, y, n) == wanted


def test_bands_are_closed_on_the_right(spark):
    rows = frame(spark, [(-12.0, 1.0), (-9.0, 2.0), (-8.9, 4.0), (6.0, 8.0), (6.1, 16.0), (None, 1.0)], "snr double, s double")
    got = {r.band: (r.n, r.mean_s) for r in stats.band_report(rows, "snr", ["s"], low=-12.0, width=3.0, bins=6).collect()}
    assert got == {0: (1, 2.0), 1: (1, 4.0), 2: (0, None), 3: (0, None), 4: (0, None), 5: (1, 8.0)}


def test_numbers_and_stripes(spark):
    rows = frame(spark, [(i * 7 % 101,) for i in range(101)], "k int")
    numbered = {r.k: r.rn for r in worklist.numbered_rows(rows, ["k"], first=1, parts=5).collect()}
    assert numbered == {k: k + 1 for k in range(101)}
    assert sorted(r.k for r in worklist.stripe(rows, ["k"], 2, 10).collect()) == list(range(2, 101, 10))
    assert sorted(r.k for r in worklist.sliced(rows, ["k"], 98).collect()) == [98, 99, 100]
    assert sorted(r.k for r in worklist.sliced(rows, ["k"], 10, 2).collect()) == [10, 11]


def test_lookup_is_strict(spark):
    rows = frame(spark, [("a",), ("b",)], "k string")
    assert worklist.lookup(rows, frame(spark, [("a", 1), ("b", 2)], "k string, v int"), ["k"]).count() == 2
    with pytest.raises(Exception, match="no match"):
        worklist.lookup(rows, frame(spark, [("a", 1)], "k string, v int"), ["k"]).collect()


def test_disjoint_counts(spark):
    rows = [("s1", "e1", "l1"), ("s1", "e2", "l2"), ("s2", "e1", "l2"), ("s2", "e2", "l3"), (None, "e3", "l1"), ("s1", "e1", "l1")]
    counted = worklist.disjoint_counts(frame(spark, rows, "s string, e string, l string"), ["s", "e", "l"])
    got = {(r.s, r.e, r.l): r.n_train for r in counted.collect()}
    for a in rows:
        assert got[a] == sum(all(p != q for p, q in zip(a, b, strict=True)) for b in rows)


def test_candidates(spark):
    items = frame(spark, [(1, "a", 5), (2, "a", 9), (3, "b", 1)], "i int, g string, need int")
    pool = frame(spark, [("a", 5, 30), ("a", 8, 10), ("a", 2, 1)], "g string, have int, p int")
    got = worklist.nearest_candidate(items, pool, equal=["g"], need="need", have="have", order=F.col("p"), pick=["p"])
    assert {r.i: r.p for r in got.collect()} == {1: 10, 2: None, 3: None}


def test_set_operations(spark):
    one, two = frame(spark, [(1,), (2,), (2,)], "k int"), frame(spark, [(2,), (3,)], "k int")
    assert tuple(worklist.set_check(one, two, ["k"]).first()) == (1, 1, 1)
    assert sorted(r.k for r in worklist.once(one, two, ["k"]).collect()) == [1, 3]


def test_splits(spark):
    rows = frame(spark, [(i, i // 10) for i in range(100)], "k int, g int")
    held = splits.hold_out(rows, "g", 0.35, 1).collect()
    assert len({r.g for r in held if r.held_out}) == 3 and len(held) == 100
    parts = splits.prompt_split(rows, "g", 45, 2).collect()
    assert sum(r.n for r in parts if r.split == "train") == 50
