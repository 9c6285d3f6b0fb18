import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import topk


def brute(rows, k, every):
    def vector(e):
        if e is None or any(x is None or not math.isfinite(x) for x in e):
            return None
        return [math.floor(64 * float(np.float32(x))) for x in e]

    good = [(i, v) for i, e in rows if i is not None and (v := vector(e)) is not None]
    out = set()
    for i, v in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]  # noqa: B905
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def run(spark, rows, k=3, every=4, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % every == 0, k=k, **how).collect()}


def test_random_vectors_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    assert run(spark, rows) == brute(rows, 3, 4)
    assert run(spark, rows, block=7, bins=4) == brute(rows, 3, 4)
    assert run(spark, rows, k=500) == brute(rows, 500, 4)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [0.5, 0.25]) for i in range(60)] + [(60 + i, [0.0, 1.0 + i % 2]) for i in range(20)]
    assert run(spark, rows, k=5) == brute(rows, 5, 4)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (4, None), (8, [1.0, None]), (12, [float("nan"), 1.0]), (16, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [3.0]), (2, []), (20, [-1.0, -1.0])]
    assert run(spark, rows) == brute(rows, 3, 4)


def test_large_components(spark):
    rows = [(i, [1000.0 * i, -500.5 + i, 3.25]) for i in range(20)]
    assert run(spark, rows) == brute(rows, 3, 4)


def test_one_vector_too_large_for_doubles_leaves_the_others_as_they_are(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    for large in ([4e12, -1.0, 2.0, 0.0], [2e6, 2e6, -2e6, 1.0], [3e14, 0.0, 0.0, 1.0]):
        assert run(spark, [*rows, (44, large), (45, large[::-1])]) == brute([*rows, (44, large), (45, large[::-1])], 3, 4)


def test_scores_beyond_a_long_are_its_ends(spark):
    rows = [(0, [3e38, 1.0]), (4, [1e30, 0.0]), (1, [1.0, 0.5]), (2, [-1.0, 2.0]), (3, [0.0, 1.0]), (5, [2.0, 0.0])]
    ends = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    vectors = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in rows}
    wanted = set()
    for i in (0, 4):
        scored = sorted((-ends(sum(a * b for a, b in zip(vectors[i], w, strict=True))), j) for j, w in vectors.items() if j != i)[:3]
        wanted |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    assert run(spark, rows) == wanted


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(0, 70), min_size=2, max_size=8), st.integers(0, 10**6))
def test_inner_products_are_exact(width, bits, seed):
    rng = np.random.default_rng(seed)
    matrix = np.array([[float(int(rng.integers(-(2**20), 2**20)) * 2 ** max(0, b - 20) >> max(0, 20 - b)) for _ in range(width)] for b in bits])
    half = len(matrix) // 2
    got = topk.inner_products(matrix[:half], matrix[half:])
    exact = [[max(-(2**63 - 1), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for b in matrix[half:].tolist()] for a in matrix[:half].tolist()]
    assert got.tolist() == exact


def test_a_long_vector_among_short_ones(spark, monkeypatch):
    monkeypatch.setattr(topk, "NUMBERS", 300)
    rows = [(i, [float(i % 7), 1.0]) for i in range(30)] + [(32, [1.0] * 250), (33, [0.5] * 90)]
    assert run(spark, rows) == brute(rows, 3, 4)


def test_no_rows_or_queries(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == set()
    assert run(spark, [(4, [1.0])]) == set()
