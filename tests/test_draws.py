"""Draws in closed form against the distributions they stand for."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import draws
from earshot.functions import levels as L
from earshot.operators import scenes, splits


def test_the_quantile_is_the_normal_one(spark):
    p = [1e-300, 1e-16, 1e-9, 0.001, 0.02, 0.07, 0.0750001, 0.3, 0.5, 0.7, 0.93, 0.999, 1 - 1e-12]
    rows = spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0, -1.0]], "p double").select("p", draws.normal_quantile(F.col("p")).alias("z")).collect()
    got = {r.p: r.z for r in rows}
    for v in p:
        assert got[v] == pytest.approx(NormalDist().inv_cdf(v), rel=1e-12, abs=1e-14)
    assert got[0.0] is got[1.0] is got[-1.0] is None


def test_bounded_draws_have_the_moments_of_the_cut_distribution(spark):
    x = np.array([r[0] for r in spark.range(40_000).select(scenes.bounded_gauss(F.col("id"), "turn", 3, 2.0, 3.0)).collect()])
    a = 1.5  # bound over spread
    inside = 1 - 2 * NormalDist().cdf(-a)
    variance = 4 * (1 - 2 * a * NormalDist().pdf(a) / inside)
    assert np.abs(x).max() <= 3.0 and len(set(x)) > 39_900
    assert x.mean() == pytest.approx(0, abs=0.03) and x.var() == pytest.approx(variance, rel=0.03)
    assert (np.abs(x) > 2.9).mean() == pytest.approx(2 * (NormalDist().cdf(1.5) - NormalDist().cdf(1.45)) / inside, rel=0.15)


def test_weights_decide_how_often_a_row_is_drawn_first(spark):
    groups = spark.range(6000).select((F.col("id") % 3).alias("row"), F.floor(F.col("id") / 3).alias("g"), (F.col("id") % 3 + 1).alias("w"), "id", F.lit(7).alias("_draw"))
    got = splits.weighted_sample(groups, ["g"], "id", "w", 2, 1)
    first = {r.row: r["count"] / 2000 for r in got.where("rank = 1").groupBy("row").count().collect()}
    assert got.count() == 4000 and got.columns == [*groups.columns, "rank"]
    assert [first[i] for i in range(3)] == pytest.approx([1 / 6, 2 / 6, 3 / 6], abs=0.04)
    # the second is drawn from those that are left: row 0 comes second after row 1 or row 2
    second = got.where("rank = 2 AND row = 0").count() / 2000
    assert second == pytest.approx(2 / 6 * 1 / 4 + 3 / 6 * 1 / 3, abs=0.04)


def test_rows_without_weight_are_not_drawn(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, None), (3, -1.0), (4, 2.0)], "k long, w double").withColumn("g", F.lit("x"))
    assert [r.k for r in splits.weighted_sample(rows, ["g"], "k", "w", 3, 1).collect()] == [4]


def test_sources_that_share_a_label_share_a_gain(spark):
    rows = spark.createDataFrame([(1, [1.0, 3.0, 8.0], ["a", "a", "b"]), (2, [1.0, 2.0], ["a", "b"]), (3, [], []), (4, [1.0, 3.0, 5.0, 7.0], ["a", "a", "b", "b"]), (5, [2.0, 4.0], [None, None])], "k int, g array<double>, l array<string>")
    got = {r.k: r.x for r in rows.select("k", L.shared_gains(F.col("g"), F.col("l")).alias("x")).collect()}
    assert got == {1: [2.0, 2.0, 8.0], 2: [1.0, 2.0], 3: [], 4: [4.0] * 4, 5: [3.0, 3.0]}


def test_references_are_delayed_by_ear(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], 2, 1)], "a array<double>, b array<double>, i int, j int")
    (d,) = rows.select(L.delayed_references(F.col("a"), F.col("b"), F.col("i"), F.col("j")).alias("d")).first()
    assert (d.left, d.right) == ([0.0, 0.0, 1.0, 2.0], [0.0, 3.0, 4.0, 0.0])
