import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import language, quality, textvec, toxicity

DATA = "/root/testdata/check_s"
SMALL = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def labelled(spark, edges, label):
    rows = [(1, 1), (2, 0), (3, 1), (4, None), (6, 0), (7, 1), (None, 1), (99, 0)]
    return spark.createDataFrame(rows, f"doc_id long, {label} int")


def test_word_hashes_depend_on_letters_alone():
    one, two = textvec.code_points(["ab cd ab", "x", "cd"]), textvec.code_points(["cd"])
    w = textvec.words(one, textvec.letters(one.points))
    v = textvec.words(two, textvec.letters(two.points))
    assert w.hashes[0] == w.hashes[2] and w.hashes[1] == w.hashes[4] == v.hashes[0] and len(set(w.hashes.tolist())) == 3
    assert w.first.tolist() == [0, 3, 4, 5]


def test_ngrams_stay_within_texts():
    t = textvec.code_points(["abcd", "", "ab"])
    assert (textvec.ngram_ends(t, 3) - t.starts).tolist() == [2, 0, 0]
    g = textvec.ngrams(t.points, 2, 16)
    assert g[0] == g[t.starts[2]]


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges_have_scores_that_do_not_depend_on_neighbours(spark, edges, none, module, label):
    model = module.fit(edges, labelled(spark, edges, label))
    out = "score" if module is quality else "toxicity"
    docs = edges.select("doc_id", "text", "lang")
    rows = module.score(docs, model).collect()
    assert len(rows) == edges.count() and all(0 <= r[out] <= 1 for r in rows)
    again = {(r.doc_id, r.text): r[out] for r in module.score(docs.repartition(5), model).collect()}
    assert all(again[r.doc_id, r.text] == r[out] for r in rows)
    assert module.score(none, model).count() == 0
    with pytest.raises(ValueError):
        module.score(edges.withColumn(out.upper(), F.lit(1)), model)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels(spark, edges, module, label):
    nothing = spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.fit(edges, nothing)
    assert all(0 <= r[-1] <= 1 if module is quality else True for r in module.score(edges.select("doc_id", "text"), model).collect())


def test_offending_sentences():
    bad = ["awful", "nasty"]
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    texts, y = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(vocabulary, 8)) for _ in range(4)]
        y.append(i % 4 == 0)
        if y[-1]:
            sentences[i % 3] += " " + bad[i // 4 % 2]
        texts.append(". ".join(sentences) + ".")
    model = toxicity.train(texts, np.array(y, int), {0: 300, 1: 100})
    text = "Abc def ghi. You NASTY thing! Abc."
    s = toxicity.sentences([text])
    p = 1 / (1 + np.exp(-model.sentence_logits(s)))
    assert [text[a:b] for a, b in zip(s.starts, s.ends, strict=True)] == ["Abc def ghi", "You NASTY thing", "Abc"]
    assert p[1] > 0.5 > max(p[0], p[2])
    scores = model.scores(toxicity.sentences(texts))
    assert ((scores >= 0.3) == np.array(y)).mean() > 0.97


def test_letters_whose_lower_case_is_longer_leave_the_rest_folded():
    text = "İSTANBUL Nasty. \u0130x ΣΟΣ"
    assert len(toxicity.folded(text)) == len(text) and toxicity.folded(text).startswith("istanbul nasty.")
    s, plain = toxicity.sentences([text]), toxicity.sentences(["istanbul nasty"])
    assert [text[a:b] for a, b in zip(s.starts, s.ends, strict=True)] == ["İSTANBUL Nasty", "İx ΣΟΣ"]
    assert s.buckets[:2].tolist() == plain.buckets.tolist()


def word_buckets(word):
    (row,) = toxicity.sentences([word]).buckets.tolist()
    return row


def test_sentence_and_document_scores_by_brute_force():
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.integers(-(1 << 16), 1 << 16, 1 << toxicity.BITS), -textvec.FIXED, 0.4)
    texts = ["One two three. Four! five\nsix? seven", "", "...", "Eight nine"]
    s = toxicity.sentences(texts)
    wanted_logits, wanted_scores = [], []
    for text in texts:
        none = 1.0
        for sentence in "".join("|" if c in ".!?\n" else c for c in text).split("|"):
            words = sentence.lower().split()
            if words:
                z = (sum(int(model.table[b]) for w in words for b in word_buckets(w)) + model.bias) / textvec.FIXED
                wanted_logits.append(z)
                none *= 1 - 1 / (1 + np.exp(-z))
        p = min(max(1 - none, 1e-12), 1 - 1e-12)
        wanted_scores.append(1 / (1 + np.exp(-(np.log(p / (1 - p)) + 0.4))))
    assert model.sentence_logits(s) == pytest.approx(wanted_logits)
    assert model.scores(s) == pytest.approx(wanted_scores, rel=1e-6)


def test_first_step_of_the_fit_by_brute_force(monkeypatch):
    """Slopes of the noisy-or likelihood by differences, against the weights after one step over all texts."""
    texts = ["bad word here. fine day", "bad again", "fine day. good word", "good day today", "bad bad thing", "nice thing", "awful bad day", "nice day. good"]
    y = np.array([1, 1, 0, 0, 1, 0, 1, 0])
    monkeypatch.setattr(toxicity, "BATCH", len(texts))
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 0)
    monkeypatch.setattr(toxicity, "LEAST_RATIO", 3.0)
    model = toxicity.train(texts, y, {0: 4, 1: 4}, epochs=1)
    active = {b for b in np.flatnonzero(model.table).tolist()}
    assert active == set(word_buckets("bad"))

    def loss(weight, bias):
        total = 0.0
        for text, label in zip(texts, y, strict=True):
            none = 1.0
            for sentence in text.split("."):
                z = sum(weight.get(b, 0.0) for w in sentence.split() for b in word_buckets(w)) + bias
                none *= 1 - 1 / (1 + np.exp(-z))
            total -= np.log(1 - none) if label else np.log(none)
        return total / len(texts)

    e = 1e-5
    slope = {b: (loss({b: e}, -4.0) - loss({b: -e}, -4.0)) / (2 * e) for b in active}
    for b, g in slope.items():
        g *= len([x for x in word_buckets("bad") if x == b]) or 1
        assert model.table[b] / textvec.FIXED == pytest.approx(-g / np.sqrt(1e-4 + g * g), rel=1e-3)
    g = (loss({}, -4.0 + e) - loss({}, -4.0 - e)) / (2 * e)
    assert model.bias / textvec.FIXED == pytest.approx(-4.0 - g / np.sqrt(1e-4 + g * g), rel=1e-3)


def test_noisy_or_is_exact():
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.int64), -textvec.FIXED, 0.0)
    p = 1 / (1 + np.e)
    assert model.scores(toxicity.sentences(["a. b. c", "a"])) == pytest.approx([1 - (1 - p) ** 3, p])


def test_bayes_equals_brute_force():
    rng = np.random.default_rng(1)
    table = np.round(rng.normal(-5, 1, (2, 3, 1 << language.BITS)) * textvec.FIXED).astype(np.int32)
    model = language.Model(["a", "b"], table, np.log([0.3, 0.7]))
    texts = ["Hello", "x", "12 !", "ñandú \U0001f600"]
    got, score = model.predict(texts)
    for text, lang, s in zip(texts, got, score, strict=True):
        total = np.log([0.3, 0.7])
        points = np.array([ord(c) for c in text.lower()], np.uint32)
        for g, n in enumerate(language.GRAMS):
            for i in range(len(points) - n + 1):
                total += table[:, g, textvec.ngrams(points[i : i + n], n, language.BITS)[0]] / textvec.FIXED
        if not any(c.isalpha() for c in text):
            assert (lang, s) == ("und", 0)
        else:
            p = np.exp(total - total.max())
            assert lang == "ab"[int(np.argmax(total))] and s == pytest.approx((p / p.sum()).max())


def test_language_counts_and_edges(spark, edges, none):
    model = language.fit(edges)
    assert model.languages == ["de", "en", "fr"]
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(edges.drop("lang"), model).collect()}
    assert out[3] == ("und", 0) and out[4] == ("und", 0) and out[8] == ("und", 0) and out[1][0] == "en"
    empty = language.fit(none)
    assert {r.lang_pred for r in language.identify(edges, empty).collect()} == {"und"}


def accuracy(spark, query, label, remainder, of):
    import __spark_entry__

    rows = __spark_entry__.queries()[query](spark, SMALL)
    for r in rows.limit(20).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == remainder)
    return rows


@needs_data
def test_held_out_quality(spark):
    rows = accuracy(spark, "op6_quality", "quality", 0, 5).where("held_out").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    assert np.mean([r.predicted for r in good]) >= 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9


@needs_data
def test_held_out_toxicity(spark):
    rows = accuracy(spark, "op7_toxicity", "toxic", 2, 4).where("held_out").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.88
    assert hits >= 0.8 * sum(r.predicted for r in rows) and hits >= 0.5 * sum(r.toxic for r in rows)  # calling all clean has neither


@needs_data
def test_held_out_language(spark):
    rows = accuracy(spark, "op8_language", "lang", 0, 5).where("held_out").join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.99
