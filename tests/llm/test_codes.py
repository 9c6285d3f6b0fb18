import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import codes

LARGEST = 2**63 - 1
SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts=4, entries=256, rounds=4):
    """The whole in plain Python, every part by itself."""
    ends = lambda x: max(-(2**63), min(math.floor(x), LARGEST))
    kept = []
    for i, e, label in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [ends(1024 * float(np.float32(x))) for x in e], label))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(v, p)].append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        code = [near(v, p) for p in range(parts)]
        error = min(sum(min(far(cut(v, p), books[p][e]), LARGEST) for p, e in enumerate(code)), LARGEST)
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(by_label[label], LARGEST)) for i, c, e, label in out), key=str), digest


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got, books = codes.compressed(frame, **how)
    assert got.columns == ["vec_id", "code", "error", "label_error"]
    return sorted((tuple(r) for r in got.collect()), key=str), codes.digest(books)


def test_few_entries_many_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.5, -2.0, 0.25, 0.5, 1.0, 1.0, 0.0, -0.5] if i % 3 == 0 else rng.normal(size=8).tolist(), i % 4 if i % 5 else None) for i in range(200)]
    assert run(spark, rows, entries=6) == brute(rows, entries=6)


def test_fewer_vectors_than_entries(spark):
    rows = [(i, [i * 0.1, 0.2, 0.2, 1.0], 1) for i in range(9)]
    assert run(spark, rows) == brute(rows)


def test_hot_parts_and_labels_meet_their_codes_in_several_tasks(spark, monkeypatch):
    from earshot.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [0.5] * 4 if i < 40 else rng.normal(size=4).tolist(), 0 if i < 50 else None) for i in range(70)]
    assert run(spark, rows, entries=5) == brute(rows, entries=5)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (0, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (0, [0.0], None), (None, [2.0, 2.0], None), (3, None, 1), (4, [1.0, None], 1), (5, [nan], 1), (6, [inf], 1), (7, [], 2), (8, [1e-9, -1e-9], 2)]
    assert run(spark, rows, entries=3) == brute(rows, entries=3)


def test_numbers_that_doubles_do_not_hold(spark):
    rows = [(i, [1e30 if i == 4 else 1e7 * i, -1e8 + i, 3.25, 1.0 * i], i % 2) for i in range(12)]
    assert run(spark, rows, entries=4) == brute(rows, entries=4)


def test_no_vectors(spark):
    assert run(spark, []) == brute([])
    assert run(spark, [(1, None, 1)]) == brute([(1, None, 1)])
    assert run(spark, [(1, [], 1)])[0] == [(1, "00000000", 0, 0)]


def test_codes_of_more_than_two_digits_are_refused(spark):
    with pytest.raises(ValueError, match="256"):
        run(spark, [(1, [1.0], 1)], entries=300)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=20), st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=6))
def test_nearest(x, entries):
    index, error = codes.nearest(np.array(x), np.array(entries))
    for row, i, e in zip(x, index, error, strict=True):
        far = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in entries]
        assert (i, e) == (far.index(min(far)), min(min(far), LARGEST))
