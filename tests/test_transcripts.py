"""Alternatives of transcripts, aligned in batches."""

import random

import numpy as np
import pytest

from earshot.functions import text as X
from earshot.operators import transcripts
from tests.test_functions import edit_table

SCHEMA = "id long, said array<string>, heard array<string>"


def test_batches_of_any_lengths(monkeypatch):
    rng = random.Random(5)
    for cells in (8, 100, X.CELLS):
        monkeypatch.setattr(X, "CELLS", cells)
        pairs = [[[rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 9, 30, 35, 45, 60]))] for _ in range(2)] for _ in range(60)]
        sides = X._numbered([x for p in pairs for x in p])
        got = X.align_many(sides[::2], sides[1::2])
        for (r, h), (hits, subs, dels, ins) in zip(pairs, got.tolist(), strict=True):
            assert (subs + dels + ins, -hits) == edit_table(r, h)
            assert hits + subs + dels == len(r) and hits + subs + ins == len(h)
    assert X.align_many([], []).shape == (0, 4)


def test_a_pair_longer_than_a_batch():
    words = np.arange(3000) % 50
    assert X.align_many([words], [words[5:]]).tolist() == [[2995, 0, 5, 0]]


def brute(said, heard, contractions):
    clean = lambda t: [w for w in spoken_form(t or "", contractions) if w]
    best = None
    for b, h in enumerate(heard):
        for a, r in enumerate(said):
            cost, less = edit_table(clean(r), clean(h))
            if best is None or -less > best[0]:
                best = (-less, cost, a, b, len(clean(r)))
    return best


def spoken_form(text, contractions):
    """Only what the test's texts need: lower case, the table, numbers, upper case."""
    out = [contractions.get(w, w) for w in text.lower().split()]
    return X.with_numbers_spoken(" ".join(out)).upper().split()


def test_the_pair_with_most_hits_counts_and_the_first_of_equal_ones(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(["a", "b", "don't", "c", "four", "quad"]) for _ in range(rng.randrange(0, 6)))
    table = {"don't": "do not", "quad": "4"}
    rows = [(i, [sentence() for _ in range(rng.randrange(1, 4))], [sentence() for _ in range(rng.randrange(1, 4))]) for i in range(40)]
    rows += [(100, rows[0][1], rows[0][2]), (101, [None, "a"], ["a"]), (102, None, ["a b"]), (103, ["a"], None), (104, ["a b", "b a"], ["a"])]
    got = {r.id: r.score for r in transcripts.scored(spark.createDataFrame(rows, SCHEMA).repartition(3), "said", "heard", contractions=table).collect()}
    assert len(got) == len(rows)
    for i, said, heard in rows:
        hits, cost, a, b, n = brute(said or [""], heard or [""], table)
        s = got[i]
        assert (s.hits, s.substitutions + s.deletions + s.insertions, s.reference, s.hypothesis) == (hits, cost, a, b)
        assert s.correctness == (pytest.approx(hits / n) if n else None)
    assert (got[104].reference, got[104].hypothesis) == (0, 0)


def test_texts_without_alternatives(spark):
    frame = spark.createDataFrame([(1, "I'm gonna go!", "i am going to go"), (2, None, "x"), (3, "x", None), (4, "", "")], "id long, said string, heard string")
    got = {r.id: r.score for r in transcripts.scored(frame, "said", "heard", contractions={"i'm": "i am", "gonna": "going to"}).collect()}
    assert (got[1].hits, got[1].correctness) == (5, 1.0)
    assert (got[2].insertions, got[2].correctness) == (1, None) and (got[3].deletions, got[3].correctness) == (1, 0.0)


def test_no_forms_and_no_rows(spark):
    got = transcripts.scored(spark.createDataFrame([(1, [], ["a"]), (2, ["a"], [])], SCHEMA), "said", "heard").collect()
    assert [(r.score.hits, r.score.reference, r.score.hypothesis, r.score.correctness) for r in got] == [(0, None, None, None)] * 2
    assert transcripts.scored(spark.createDataFrame([], SCHEMA), "said", "heard").collect() == []


@pytest.mark.parametrize(("text", "words"), [("3.14 and 105", "three point one four and one hundred five"), ("3rd", "3rd"), ("x 4", "x four"), ("", "")])
def test_numbers_of_a_table_are_spoken(text, words):
    assert X.with_numbers_spoken(text) == words
