import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import packing


@pytest.fixture(scope="module")
def coder():
    return packing.Encoder(packing.tokenizer_path())


@pytest.fixture(scope="module")
def fresh():
    """A tokenizer of its own, which remembers nothing of the coder's."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_ids_are_the_tokenizers(coder, fresh, text):
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_ids_of_hard_texts(coder, fresh):
    for text in ("it's they'll I'D don't''s", "ΟΔΟΣ οδος Σ", "á Å ﬁ ½ ²", "x\x1cy z\x85w　v", "<|endoftext|> 123 4a5!!?", "İstanbul ẞ"):
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["one", "two,", "three!", "fourth", "don't", "6", "seven's"]), max_size=40))
def test_ids_when_few_words_are_remembered(fresh, words):
    small = packing.Encoder(packing.tokenizer_path(), cache_words=2)
    text = " ".join(words)
    assert np.frombuffer(small.ids(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
    for held in (small.chunks, small.chunks.words):
        assert len(held) <= 2 and len(held.older) <= 2


def best(demand, capacity):
    """Fewest sequences, by search over all orders of first-fit."""
    items = [i + 1 for i, n in enumerate(demand) for _ in range(n)]
    least = len(items)
    for order in set(itertools.permutations(items)):
        bins = []
        for x in order:
            for i, b in enumerate(bins):
                if b + x <= capacity:
                    bins[i] += x
                    break
            else:
                bins.append(x)
        least = min(least, len(bins))
    return least


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=6, max_size=6).filter(lambda d: 0 < sum(d) <= 6))
def test_patterns_meet_demand_nearly_best(demand):
    found = packing.solve_patterns(np.array(demand), 6)
    assert sum(p * n for p, n in found).tolist() == demand
    assert all((p * np.arange(1, 7)).sum() <= 6 for p, _ in found)
    assert sum(n for _, n in found) <= best(demand, 6) + 1


def test_patterns_of_many_pieces_waste_little():
    demand = np.random.default_rng(1).integers(500, 1500, 64)
    found = packing.solve_patterns(demand, 128)
    assert sum(p * n for p, n in found).tolist() == demand.tolist()
    assert sum(n for _, n in found) <= 1.002 * np.ceil((demand * np.arange(1, 65)).sum() / 128)


def check(rows, docs, coder):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    pieces = sorted((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    wanted = []
    for doc_id, text in docs:
        ids = np.append(np.frombuffer(coder.ids(text or ""), "<u4"), 1).astype("<u4")
        wanted += [(doc_id is None, doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert pieces == sorted(wanted)


def test_every_id_in_one_piece(edges, coder):
    check(packing.packed_documents(edges).collect(), [(r.doc_id, r.text) for r in edges.collect()], coder)


def test_no_documents(none):
    assert packing.packed_documents(none).collect() == []


def test_extra_columns_stay(spark):
    rows = spark.createDataFrame([(1, 0, 5, "x"), (2, 0, 2048, "y"), (2, 0, 2048, "y")], "doc_id long, start long, length long, shard string")
    out = packing.pack(rows)
    assert out.columns == ["doc_id", "start", "length", "shard", "sequence_id", "offset"]
    assert len({r.sequence_id for r in out.collect()}) == 3


def test_columns_named_as_inner_ones_stay(spark):
    names = ["_class", "_shard", "_in_shard", "_before", "_rank", "_slots", "_slot", "_n"]
    rows = spark.createDataFrame([(i, 0, 100 * i + 1, *range(i, i + 8)) for i in range(20)], "doc_id long, start long, length long, " + ", ".join(f"{n} long" for n in names))
    out = packing.pack(rows)
    assert out.columns == [*rows.columns, "sequence_id", "offset"]
    assert all(tuple(r[n] for n in names) == tuple(range(r.doc_id, r.doc_id + 8)) for r in out.collect())


def test_rows_of_one_id_are_told_apart(spark):
    docs = spark.createDataFrame([(None, "a b c " * i) for i in range(1, 60)] + [(3, "x y z " * i) for i in range(1, 60)], "doc_id long, text string")
    once, again = (sorted(map(str, packing.packed_documents(d).collect())) for d in (docs.repartition(5), docs.repartition(2)))
    assert once == again
