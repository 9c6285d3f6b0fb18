"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in its hashed words and their first letters
(compounds share those). A document is toxic
unless every sentence is not (noisy-or), and that is what is fitted to document
labels, on a bounded sample, by numpy gradient descent with per-weight rates.
The sentence scores then show which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import textvec as tv
from earshot.llm.common import chunks, schema_with, table, with_columns
from earshot.llm.labelled import labelled_sample
from earshot.llm.quality import held_out

BITS = 18
#: Bound of the sample: texts of each label.
PER_CLASS = 4000
#: A word has a weight if toxic texts hold it more often than others do by this log-likelihood ratio (about one chance in 4000 without cause).
LEAST_RATIO = 13.5
#: A small sample is gone through more often, up to about so many steps.
LEAST_STEPS = 800
EPOCHS, BATCH, RATE, DECAY = 12, 64, 1.0, 1e-5
#: A word counts as itself and as each of its beginnings of so many letters.
PREFIXES = (4, 5)
LEAST_SCORE = 0.3
#: Code points that end a sentence.
ENDS = (0x2E, 0x21, 0x3F, 0x0A)


@dataclass
class Sentences:
    """Words' buckets (a column for the word and each of its beginnings), each sentence's first and last word, its first and last code point, and each text's first sentence (with the end)."""

    buckets: np.ndarray
    word_first: np.ndarray
    word_last: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


#: Letters whose lower case is longer than they are, and its first letter.
LONGER = {i: chr(i).lower()[0] for i in range(0x10FFFF) if len(chr(i).lower()) > 1}


def folded(text: str) -> str:
    """Lower case with as many code points as the text has, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(LONGER).lower()


def sentences(texts: list[str]) -> Sentences:
    """Stretches between full stops, exclamation and question marks and line ends that hold a word; words are runs of letters, case folded."""
    arrays = tv.code_points([folded(t) for t in texts])
    points = arrays.points
    w = tv.words(arrays, tv.letters(points), PREFIXES)
    breaks = np.zeros(len(points) + 1, np.int64)
    np.cumsum(np.isin(points, np.array(ENDS, np.uint32)) | (points == 0), out=breaks[1:])
    part = breaks[w.starts]  # words with as many breaks before them share a sentence
    word_first = np.flatnonzero(np.diff(part, prepend=-1))
    word_last = np.append(word_first[1:], len(part))
    starts = w.starts[word_first] if len(word_first) else np.zeros(0, np.int64)
    ends = w.ends[word_last - 1] if len(word_first) else np.zeros(0, np.int64)
    first = np.append(np.searchsorted(starts, arrays.starts), len(starts))
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    base = arrays.starts[text]
    return Sentences((w.hashes >> np.uint64(64 - BITS)).astype(np.int64), word_first, word_last, starts - base, ends - base, first)


@dataclass
class Model:
    """Whole-number weight of each bucket, the weight of any sentence, and what a document's log-odds are moved by."""

    table: np.ndarray
    bias: int
    shift: float

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        return (tv.sums_between(self.table[s.buckets].sum(axis=1), s.word_first, s.word_last) + self.bias) / tv.FIXED

    def scores(self, s: Sentences) -> np.ndarray:
        """Noisy-or over a text's sentences; a text without any has the least score."""
        # log(1 - p) in whole units, so that sums are exact
        none = np.round(-np.logaddexp(0, np.clip(self.sentence_logits(s), -60, 60)) * (1 << 40)).astype(np.int64)
        log_none = tv.sums_between(none, s.first[:-1], s.first[1:]) / (1 << 40)
        p = np.clip(-np.expm1(log_none), 1e-12, 1 - 1e-12)
        return 1 / (1 + np.exp(-(np.log(p) - np.log1p(-p) + self.shift)))


def _telling(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which buckets texts of label 1 hold more often than texts of label 0, by the log-likelihood ratio of a 2 x 2 table."""
    part = lambda k, of, share: k * np.log(np.maximum(k, 1e-12) / (of * share + 1e-12)) + (of - k) * np.log(np.maximum(of - k, 1e-12) / (of * (1 - share) + 1e-12))
    share = seen.sum(axis=0) / n.sum()
    ratio = 2 * (part(seen[0], n[0], share) + part(seen[1], n[1], share))
    return (ratio >= LEAST_RATIO) & (seen[1] / n[1] > seen[0] / n[0]) & (seen[1] >= 2)


def train(texts: list[str], y: np.ndarray, counts: dict[int, int], *, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Weights under noisy-or; the prior is moved from the sample's share of labels to that of ``counts``.

    With one label or none known, no word has a weight and scores follow the share of label 1.
    """
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        base = 1e-6
        return Model(np.zeros(1 << BITS, np.int32), int(np.log(base) * tv.FIXED), prior - float(np.log(base)))
    split = [sentences([t]) for t in texts]
    seen = np.zeros((2, 1 << BITS))
    for s, label in zip(split, y, strict=True):
        seen[int(label), np.unique(s.buckets)] += 1
    active = _telling(seen, np.bincount(y, minlength=2))
    # only these have a weight: they are numbered from 1, and 0 stands for the others
    place = np.zeros(1 << BITS, np.int64)
    place[active] = np.arange(1, active.sum() + 1)
    kept = int(active.sum()) + 1
    held = [place[s.buckets] for s in split]
    weight, bias = np.zeros(kept), -4.0
    power, bias_power = np.full(kept, 1e-4), 1e-4
    rng = np.random.default_rng(seed)
    usable = [i for i, s in enumerate(split) if len(s.starts)]
    for _ in range(max(epochs, LEAST_STEPS * BATCH // max(1, len(usable)))):
        order = rng.permutation(usable)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            ids = np.concatenate([held[i] for i in some])
            n_words = np.concatenate([split[i].word_last - split[i].word_first for i in some])
            n_sents = np.array([len(split[i].starts) for i in some])
            w_first, s_first = np.cumsum(n_words) - n_words, np.cumsum(n_sents) - n_sents
            z = np.clip(np.add.reduceat(weight[ids].sum(axis=1), w_first) + bias, -30, 30)
            p = 1 / (1 + np.exp(-z))
            log_none = np.add.reduceat(np.log1p(-p), s_first)
            doc = np.clip(-np.expm1(log_none), 1e-9, 1)
            label = y[some]
            # slope by sentence: p if the document is clean, -p * (1 - doc) / doc if not
            slope = p * np.repeat(np.where(label == 1, -np.exp(log_none) / doc, 1.0), n_sents) / len(some)
            grad = np.bincount(ids.ravel(), np.repeat(slope, n_words * ids.shape[1]), kept) + DECAY * weight
            grad[0] = 0
            power += grad * grad
            weight -= RATE * grad / np.sqrt(power)
            bias_power += slope.sum() ** 2
            bias -= RATE * slope.sum() / np.sqrt(bias_power)
    sample = float(np.log((y == 1).sum() / (y == 0).sum()))
    return Model(np.round(weight * tv.FIXED).astype(np.int64)[place], int(round(bias * tv.FIXED)), prior - sample)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", learn=None, per_class: int = PER_CLASS) -> Model:
    """A model of the labelled documents whose id meets ``learn`` (all ids, if none is given)."""
    sample, counts = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class=per_class)
    return train(sample.column("_text").to_pylist(), sample.column("_y").to_numpy(), counts)


SPANS = "array<struct<start:bigint,end:bigint,score:double>>"


def score(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``offending``: sentences of probability ``least`` or more, by code points.

    A null text is an empty one; a text without words has no sentences. Other
    columns pass through, a clash of names is an error.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(at).to_pylist()):
                s = sentences(texts)
                p = 1 / (1 + np.exp(-np.clip(sent.value.sentence_logits(s), -60, 60)))
                bad = np.flatnonzero(p >= least)
                offsets = pa.array(np.searchsorted(bad, s.first).astype(np.int32))
                spans = pa.StructArray.from_arrays([pa.array(s.starts[bad]), pa.array(s.ends[bad]), pa.array(p[bad])], names=["start", "end", "score"])
                yield with_columns(batch.slice(first, len(texts)), {"toxicity": pa.array(sent.value.scores(s)), "offending": pa.ListArray.from_arrays(offsets, spans)})

    return docs.mapInArrow(run, schema_with(docs, "toxicity double") + f", offending {SPANS}")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out(2, 4))
    scored = score(docs, model).withColumnRenamed("toxicity", "score")
    return scored.select("doc_id", F.coalesce(held_out(2, 4), F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
