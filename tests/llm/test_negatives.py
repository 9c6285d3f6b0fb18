import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import negatives

LARGEST = 2**63 - 1
SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, positives=5, least=10, every=4, window=(30, 90)):
    ends = lambda x: max(-(2**63), min(math.floor(x), LARGEST))
    good = []
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((i, [float(ends(256 * float(np.float32(x)))) for x in e], label))
    out = []
    for i, v, label in good:
        if i % every:
            continue
        scored = [(-max(-LARGEST, min(LARGEST, sum(int(a) * int(b) for a, b in zip(v, w)))), j, other) for j, w, other in good if j != i]  # noqa: B905
        for s, j, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            fits = sorted(r for r in scored if r[2] != label and window[0] * -s <= 100 * -r[0] <= window[1] * -s)[:least]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, every=4, **how):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mined(frame, F.col("vec_id") % every == 0, **how).collect())


@pytest.mark.parametrize("dimensions", [32, 3])
def test_random_vectors_in_many_blocks(spark, monkeypatch, dimensions):
    monkeypatch.setattr(negatives, "DIMENSIONS", dimensions)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    monkeypatch.setattr(negatives, "CANDIDATES", 16)
    monkeypatch.setattr(negatives, "CELL", 2)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) + 0.7).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    got = run(spark, rows)
    assert got == brute(rows) and len({r[0] for r in got}) > 30


def test_one_label_holds_most_rows_and_copies_tie(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.5] if i % 2 else [0.5, 1.0] if i % 3 else rng.normal(size=2).tolist(), 0 if i % 5 else 1) for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.5], 1), (1, [1.0, 1.5], 1), (1, [1.0, 1.5], 1), (2, [0.5, 1.0], 2), (2, [0.5, 1.0], 2), (3, [1.0], 2), (4, [], 1), (8, None, 1), (12, [nan], 1), (16, [inf], 2), (20, [1.0, None], 1), (24, [1.0, 1.0], None), (None, [0.5, 0.5], 2), (28, [-1.0, -1.0], 2), (29, [-1.0, 0.0], 2)]
    got = run(spark, rows)
    assert got == brute(rows) and got


def test_scores_that_doubles_or_longs_do_not_hold(spark):
    rows = [(i, [1e7 * (i + 1), 2.0**20 + i, 0.5], i % 2) for i in range(16)]
    assert run(spark, rows) == brute(rows)
    rows[5] = (5, [1e25, 1.0, 1.0], 1)
    assert run(spark, rows) == brute(rows)


def test_nothing_to_mine(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1)]) == []
    assert run(spark, [(4, [1.0], 1), (5, [1.0], 2)]) == []  # no positive
    assert run(spark, [(4, [1.0], 1), (5, [1.0], 1)]) == []  # no row of another label


def test_window_and_numbers_are_parameters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) + 1).tolist(), i % 2) for i in range(40)]
    assert run(spark, rows, positives=2, negatives=3, window=(10, 200)) == brute(rows, 2, 3, window=(10, 200))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=6, max_size=6), min_size=1, max_size=4), st.integers(1, 8), st.integers(-3, 3))
def test_best(scores, k, floor):
    scores = np.array(scores, np.int64)
    fits = scores >= floor
    row, column = negatives._best(scores, fits, k)
    got = sorted(zip(row.tolist(), column.tolist(), strict=True))
    want = [(i, c) for i in range(len(scores)) for c in sorted(np.flatnonzero(fits[i]), key=lambda c: (-scores[i, c], c))[:k]]
    assert got == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 62), st.integers(1, 7))
def test_tiles_add_up(bits, cut):
    rng = np.random.default_rng(bits)
    one, two = (np.floor(rng.normal(size=(n, 7)) * 2.0**bits) for n in (3, 4))
    bound = float(np.sqrt((one**2).sum(1)).max() * np.sqrt((two**2).sum(1)).max()) * (1 + 1e-9)
    tiles = [negatives.product(one[:, c : c + cut], two[:, c : c + cut], bound) for c in range(0, 7, cut)]
    want = [[max(-LARGEST, min(LARGEST, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in two.tolist()] for x in one.tolist()]
    assert negatives.added(tiles, 3, 4).tolist() == want
