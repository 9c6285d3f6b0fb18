import itertools
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import neardup

rng = np.random.default_rng(7)
VOCABULARY = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(4000)]


def text(n=80):
    return " ".join(rng.choice(VOCABULARY, n))


def edited(source, times):
    words = source.split()
    for _ in range(times):
        words[rng.integers(len(words))] = str(rng.choice(VOCABULARY))
    return " ".join(words)


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows, least=0.8):
    """By brute force over all pairs, with unweighted counts."""
    sets, parent = [shingles(t or "") for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = 0
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a is None or b is None:
                continue
            union = sum((sets[i] | sets[j]).values())
            s = sum((sets[i] & sets[j]).values()) / union if union else float(a == b)
            near += abs(s - least) < 0.05
            if s >= least or a == b:
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return {r: min(m) for m in members.values() for r in m}, near


def corpus():
    rows = [text() for _ in range(150)]
    base = text(200)
    rows += [base] * 5 + [edited(base, 1) for _ in range(60)]  # a large group of near copies
    passage = text(50)
    rows += [f"{text(300)} {passage} {text(300)}" for _ in range(20)]  # a passage that many share
    for _ in range(15):
        one = text(120)
        rows += [one, one.upper() + " !", edited(one, 1)]
    rows += ["", "", " ", "one", "one", "one two", None, None, "word " * 500, "word " * 501]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(docs).collect()
    wanted, _ = classes(rows)
    got = {r.id: r.class_id for r in found}
    wrong = [i for i in got if got[i] != wanted[i]]
    assert not wrong, [(rows[i], got[i], wanted[i]) for i in wrong][:3]
    sizes = Counter(wanted.values())
    assert all(r.class_size == sizes[wanted[r.id]] for r in found)
    assert sum(r.kept for r in found) == len(sizes)
    assert sorted(r.doc_id for r in neardup.deduplicated(docs).collect()) == sorted(sizes)


FLAT = neardup.Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0)


def vectors_of(texts, idf):
    d, w, first = neardup.weighted(*neardup.shingles(texts), idf)
    return [d[a:b].astype("<u8").tobytes() + w[a:b].astype("<f4").tobytes() for a, b in itertools.pairwise(first)]


def test_samples_agree_as_often_as_texts_are_alike():
    one, two = text(300), None
    words = one.split()
    words[::40] = text(len(words[::40])).split()
    two = " ".join(words)
    hashes = np.unique(neardup.shingles([one])[0])
    some = neardup.Idf(hashes, np.linspace(1, 2, len(hashes), dtype=np.float32), 2.0)
    for idf in (FLAT, some):
        d, w, first = neardup.weighted(*neardup.shingles([one, two]), idf)
        got = neardup.samples(d, np.log(w), first, 250)
        true = neardup._similarity(*vectors_of([one, two], idf))
        assert (got[0] == got[1]).mean() == pytest.approx(true, abs=4 * np.sqrt(true * (1 - true) / 250))


def test_profiles_bound_similarities_from_above():
    base = text(150)
    rows = [edited(base, n) for n in (0, 1, 3, 6, 10, 20, 60)] + [text(n) for n in (1, 3, 5, 9, 40, 4000)] + ["word " * 700]
    idf = neardup.Idf(np.unique(neardup.shingles([base])[0]), np.linspace(1, 2, 146, dtype=np.float32), 2.0)
    found, profile = vectors_of(rows, idf), neardup.profiles(*neardup.weighted(*neardup.shingles(rows), idf))
    close = 0
    for i, j in itertools.product(range(len(rows)), repeat=2):
        true = neardup._similarity(found[i], found[j])
        assert neardup.may_reach([profile[i]], [profile[j]], true - 1e-6).all()
        close += not neardup.may_reach([profile[i]], [profile[j]], min(1.0, true + 0.2)).any() if true < 0.8 else 0
    assert close > 60  # and most are not far above


def true_frequencies(texts):
    return Counter(h for t in texts if t for h in set(neardup.shingles([t])[0].tolist()))


@pytest.mark.parametrize("most, bits", [(1 << 18, 20), (300, 12), (50, 8), (3, 14)])
def test_frequencies_are_exact_from_the_floor_on(spark, most, bits):
    texts = [r[1] for r in corpus()]
    found = neardup.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text", 5, most, bits)
    wanted = true_frequencies(texts)
    assert found.floor == max(1, -(-sum(wanted.values()) // most))
    assert dict(zip(found.hashes.tolist(), found.counts.tolist(), strict=True)) == {h: n for h, n in wanted.items() if n >= found.floor}
    assert len(found.hashes) <= most and (np.diff(found.hashes.astype(object)) > 0).all()
    assert found.documents == sum(bool(t and t.strip()) for t in texts)


def test_weights_fall_with_the_logarithm_of_the_frequency():
    hashes = np.array([1, 2, 3, 4], np.uint64)
    idf = neardup.Frequencies(hashes, np.array([10, 100, 1000, 500]), 10, 1000).idf(1.0)
    assert idf.of(np.array([1, 2, 3, 4, 5], np.uint64)) == pytest.approx([2, 1.5, 1, 1 + np.log10(2) / 2, 2])
    assert neardup.Frequencies(hashes, np.array([10, 100, 1000, 500]), 10, 1000).idf(0.0).of(hashes).tolist() == [1] * 4
    assert neardup.Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 0).idf(1.0).of(hashes).tolist() == [2] * 4


def test_no_text_has_frequencies_to_count(spark, none):
    found = neardup.document_frequencies(none, "text", 5)
    assert (len(found.hashes), found.documents) == (0, 0)


def test_edges(spark, edges, none):
    found = {(r.id, r.class_id, r.class_size) for r in neardup.near_duplicates(edges).collect()}
    assert found == {(1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 2), (5, 4, 2), (None, None, 1), (6, 6, 1), (7, 7, 1), (8, 8, 1)}
    kept = neardup.deduplicated(edges.withColumn("key", F.lit(1)))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 3, 4, None, 6, 7, 8])) and kept.columns[-1] == "key"
    assert neardup.near_duplicates(none).count() == 0


def test_components_of_a_chain(spark):
    keys = [bytes([0] * 15 + [i]) for i in rng.permutation(30)]
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(keys, keys[1:], strict=False)], "a binary, b binary")
    assert {bytes(r.root) for r in neardup.components(links).collect()} == {min(keys)}


@pytest.mark.parametrize("chunk", [1, 40, 1 << 16])
def test_components_of_links_in_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK_LINKS", chunk)
    own = np.random.default_rng(3)
    ends = [sorted(own.choice(300, 2, replace=False).tolist()) for _ in range(180)] + [[300, i] for i in range(301, 340)]
    least = list(range(340))
    for _ in least:
        for a, b in ends:
            least[a] = least[b] = min(least[a], least[b])
    key = lambda i: i.to_bytes(16, "big")
    links = spark.createDataFrame([(key(a), key(b)) for a, b in ends], "a binary, b binary").repartition(7)
    found = {bytes(r.key): bytes(r.root) for r in neardup.components(links).collect()}
    assert found == {key(i): key(least[i]) for i in {x for e in ends for x in e}}
    half = neardup.components(links.limit(0)), neardup.components(links.where("hash(a, b) % 2 = 0"))
    assert half[0].count() == 0
    assert found == {bytes(r.key): bytes(r.root) for r in neardup.with_more(half[1], links.where("hash(a, b) % 2 <> 0")).collect()}


def test_rounds_take_hubs_that_the_first_pass_did_not(spark, monkeypatch):
    turns, proposed = [], neardup.proposed
    monkeypatch.setattr(neardup, "CROSSING", -1)
    monkeypatch.setattr(neardup, "proposed", lambda buckets, some: turns.append(list(some)) or proposed(buckets, some))
    neardup.near_duplicates(spark.createDataFrame(list(enumerate([text(), text()] * 2)), "doc_id long, text string")).count()
    assert len(turns) > 1 and len(set(sum(turns, []))) == sum(map(len, turns))


def hidden_pairs(pairs=130):
    """Texts at about 0.6 to 0.7 of each other by a passage they all share; each has one near copy a little above 0.8."""
    own = np.random.default_rng(11)
    passage = list(own.choice(VOCABULARY, 420))
    rows = []
    for _ in range(pairs):
        rest = list(own.choice(VOCABULARY, 85))
        rows += [" ".join(passage + rest), " ".join(passage + rest[:-42] + list(own.choice(VOCABULARY, 42)))]
    return rows


def idf_of(rows):
    wanted = true_frequencies(rows)
    hashes = np.array(sorted(wanted), np.uint64)
    documents = sum(len(neardup.shingles([t])[0]) > 0 for t in rows if t)
    return neardup.Frequencies(hashes, np.array([wanted[h] for h in hashes.tolist()]), 1, documents).idf()


def weighted_similarities(rows):
    vectors = vectors_of(rows, idf_of(rows))
    return {(i, j): neardup._similarity(vectors[i], vectors[j]) for i in range(len(rows)) for j in range(i)}


def test_pairs_hidden_among_many_texts_below_the_threshold(spark, monkeypatch):
    rows = hidden_pairs()
    near = {p: s for p, s in weighted_similarities(rows).items() if s >= 0.8}
    others = [s for p, s in weighted_similarities(rows[::2]).items()]
    assert set(near) == {(i + 1, i) for i in range(0, len(rows), 2)} and max(near.values()) < 0.88 and 0.6 < min(others) < max(others) < 0.75
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for block, size in ((8192, 1 << 27), (40, 10_000)):  # in one piece, and in blocks and parts
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "PART_BYTES", size)
        got = {r.id: r.class_id for r in neardup.near_duplicates(docs).collect()}
        assert [i for i in got if got[i] != i // 2 * 2] == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=5))
def test_chunks_of_few_words(counts):
    texts = [" ".join(f"w{i}{j}" for j in range(n)) for i, n in enumerate(counts)]
    hashes, first = neardup.shingles(texts)
    assert np.diff(first).tolist() == [n - 4 if n >= 5 else min(n, 1) for n in counts]
    for i, text in enumerate(texts):
        alone, _ = neardup.shingles([text])
        assert hashes[first[i] : first[i + 1]].tolist() == alone.tolist()


@pytest.mark.parametrize("n", [2, 3])
def test_a_table_of_one_short_text(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    rows = neardup.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.id, r.class_id, r.class_size, r.kept) for r in rows] == [(1, 1, 1, True)]
