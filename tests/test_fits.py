import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import fits


def fitted(x, y, steps=400):
    """Least squares by plain damped Gauss-Newton steps over the rows themselves."""
    p, damp = np.array([0.5, 1.0]), 1e-2
    curve = lambda p: 100 / (1 + np.exp(np.clip(-p[1] * (x - p[0]), -500, 500)))
    for _ in range(steps):
        f = curve(p)
        s = f * (1 - f / 100)
        j = np.stack([-p[1] * s, (x - p[0]) * s], axis=1)
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h)) + 1e-12 * np.eye(2), j.T @ (y - f))
        if ((y - curve(p + step)) ** 2).sum() < ((y - f) ** 2).sum():
            p, damp = p + step, damp / 3
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def scores(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, n)
    y = np.clip(100 / (1 + np.exp(-(6 + rng.integers(0, 3, n)) * (x - 0.45))) + rng.normal(0, 8, n), 0, 100)
    return [(f"s{a}", f"y{b}", f"l{c}", float(u), float(v)) for a, b, c, u, v in zip(rng.integers(0, 90, n), rng.integers(0, 8, n), rng.integers(0, 12, n), x, y, strict=True)]


SCHEMA = "signal string, system string, listener string, x double, y double"


def test_predictions_equal_a_fit_for_each_row(spark):
    rows = scores(300)
    rows[7] = (None, "y1", None, 0.4, 30.0)
    rows[8] = (None, "y2", None, 0.6, 70.0)
    got = {tuple(r)[:5]: r for r in fits.disjoint_predictions(spark.createDataFrame(rows, SCHEMA), "x", "y", ["signal", "system", "listener"]).collect()}
    assert len(got) == 300
    for row in rows:
        train = [r for r in rows if all(a != b for a, b in zip(r[:3], row[:3], strict=True))]
        x0, k = fitted(np.array([r[3] for r in train]), np.array([r[4] for r in train]))
        assert got[row].n_train == len(train)
        assert got[row].predicted == pytest.approx(100 / (1 + np.exp(-k * (row[3] - x0))), abs=1e-5)


def test_each_step_of_the_sums_is_exact(spark):
    rows = scores(500, 1)
    frame = spark.createDataFrame(rows, SCHEMA)
    x, y = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    span = (x.min(), x.max())
    sums = np.zeros((fits.CELLS, 2 * fits.NODES))
    for r in fits.histogram(frame, "x", "y", [], span).collect():
        sums[r["_cell"]] = r["_sums"]
    at = fits.node_grid(span)
    for x0, k in ((0.5, 1.0), (0.3, 12.0), (0.8, -20.0)):
        f = lambda x: 100 / (1 + np.exp(-k * (x - x0)))  # noqa: B023, E731
        assert (sums[:, : fits.NODES].ravel() * f(at) ** 2).sum() == pytest.approx((f(x) ** 2).sum(), rel=1e-8)
        assert (sums[:, fits.NODES :].ravel() * f(at)).sum() == pytest.approx((y * f(x)).sum(), rel=1e-8)


def test_groups(spark):
    rows = scores(400, 2)
    rows += [("s", None, "l", 0.1 * i, 10.0 * i) for i in range(10)] + [("s", "none", "l", None, 1.0), ("s", "none", "l", 1.0, None)]
    got = {r.system: r for r in fits.logistic_by(spark.createDataFrame(rows, SCHEMA).repartition(5), "x", "y", ["system"]).collect()}
    assert set(got) == {r[1] for r in rows if r[1] != "none"}
    for system, r in got.items():
        own = [(u, v) for _, s, _, u, v in rows if s == system]
        assert (r.n, r.x0, r.k) == (len(own), *map(lambda v: pytest.approx(v, abs=2e-6), fitted(*map(np.array, zip(*own, strict=True)))))


def test_nothing_left_to_train_on(spark):
    rows = [("a", "b", "c", 0.1, 10.0), ("a", "d", "e", 0.9, 90.0)]
    got = fits.disjoint_predictions(spark.createDataFrame(rows, SCHEMA), "x", "y", ["signal", "system", "listener"]).collect()
    assert [(r.n_train, r.predicted) for r in got] == [(0, None)] * 2
    none = spark.createDataFrame([], SCHEMA)
    assert fits.disjoint_fits(none, "x", "y", ["signal", "system"]).count() == fits.logistic_by(none, "x", "y", ["system"]).count() == 0


def test_rows_without_x_or_y_are_predicted_as_far_as_they_can_be(spark):
    rows = [*scores(60, 3), ("new", "new", "new", 0.5, None), ("new", "new", "new", None, 3.0)]
    got = [r for r in fits.disjoint_predictions(spark.createDataFrame(rows, SCHEMA), "x", "y", ["signal", "system", "listener"]).collect() if r.signal == "new"]
    assert {r.n_train for r in got} == {60} and sorted(r.predicted is None for r in got) == [False, True]


def test_no_group_gathers_its_rows(spark):
    """What is sent on after the first sums grows with cells and groups, not with rows."""
    many = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") / 200_000).alias("x"), (F.col("id") % 100).cast("double").alias("y"))
    span = (0.0, 1.0)
    assert fits.histogram(many, "x", "y", ["g"], span).count() == 3 * fits.CELLS


def test_a_fit_is_symmetric():
    x = np.arange(5.0)
    x0, k = fits.fit_weighted(x, np.ones((1, 5)), np.array([[0, 25, 50, 75, 100.0]]))[0]
    curve = 100 / (1 + np.exp(-k * (x - x0)))
    assert curve + curve[::-1] == pytest.approx(100, abs=1e-4) and k > 0
