"""A quality classifier over supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams; a softmax over two classes sits on top. Both are trained together by
numpy stochastic gradient descent on a bounded sample of labelled rows. The
softmax of an average is linear, so scoring needs one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import textvec as tv
from earshot.llm.common import chunks, crc32_of_id, schema_with, table, with_columns
from earshot.llm.labelled import labelled_sample

BITS, DIM, GRAMS = 18, 16, (3, 4)
#: Bound of the sample: texts of each label.
PER_CLASS = 1200
EPOCHS, RATE = 4, 0.4
#: A small sample is gone through more often, up to about so many steps.
LEAST_STEPS = 8000
#: A document is taken for good from this score on.
LEAST_SCORE = 0.3


def _features(texts: tv.Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket arrays, each with every text's first and last place: n-grams, words, and words that repeat the one before."""
    out = [(tv.ngrams(texts.points, n, BITS), texts.starts, tv.ngram_ends(texts, n)) for n in GRAMS]
    w = tv.words(texts, tv.not_space(texts.points))
    buckets = (w.hashes >> np.uint64(64 - BITS)).astype(np.uint32)
    again = np.zeros(len(buckets), bool)
    again[1:] = buckets[1:] == buckets[:-1]
    buckets = np.where(again, np.uint32(1), buckets)  # one bucket stands for any repetition
    return [*out, (buckets, w.first[:-1], w.first[1:])]


@dataclass
class Model:
    """Whole-number worth of each bucket for label 1 against 0, and the worth of no feature at all."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        arrays = tv.code_points(texts)
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, first, last in _features(arrays):
            total += tv.sums_between(self.table[buckets], first, last)
            n += np.maximum(last - first, 0)
        return 1 / (1 + np.exp(-np.clip(total / (tv.FIXED * np.maximum(n, 1)) + self.bias, -500, 500)))


def train(texts: list[str], y: np.ndarray, counts: dict[int, int], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    """A model of a sample; its prior is moved from the sample's share of labels to that of ``counts``.

    With one label or none known, the score is that label's share (1/2 if none).
    """
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.int32), prior)
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    heads, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = []
    for text in texts:
        parts = [b[f[0] : l[0]] for b, f, l in _features(tv.code_points([text]))]
        ids, n = np.unique(np.concatenate(parts), return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    epochs = max(epochs, LEAST_STEPS // len(bags))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, part = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            rows = vectors[ids]
            mean = np.einsum("i,ij->j", part, rows)
            logits = np.einsum("kj,j->k", heads, mean) + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = np.einsum("k,kj->j", p, heads)
            heads -= now * np.outer(p, mean)
            bias -= now * p
            # fastText moves each vector by the whole step; the average's weight keeps common n-grams apart
            vectors[ids] = rows - now * np.minimum(1, 40 * part)[:, None] * back
    worth = np.einsum("ij,j->i", vectors, heads[1] - heads[0])
    sample = float(np.log((y == 1).sum() / (y == 0).sum()))
    return Model(np.round(worth * tv.FIXED).clip(-(2**31) + 1, 2**31 - 1).astype(np.int32), float(bias[1] - bias[0]) + prior - sample)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", learn=None, per_class: int = PER_CLASS) -> Model:
    """A model of the labelled documents whose id meets ``learn`` (all ids, if none is given)."""
    sample, counts = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class=per_class)
    return train(sample.column("_text").to_pylist(), sample.column("_y").to_numpy(), counts)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; a null text is an empty one. Other columns pass through, a clash of names is an error."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(at).to_pylist()):
                yield with_columns(batch.slice(first, len(texts)), {out_col: pa.array(sent.value.scores(texts))})

    return docs.mapInArrow(run, schema_with(docs, f"{out_col} double"))


def held_out(remainder: int, of: int) -> Column:
    return F.pmod(crc32_of_id(), F.lit(of)) == remainder


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out(0, 5))
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(held_out(0, 5), F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
