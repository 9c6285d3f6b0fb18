"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from a bounded sample of labelled rows, so
many of each language; priors from all labelled rows. The matrix of
log-probabilities (languages x buckets) is broadcast and texts are scored in
batches of numpy arrays.
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
from earshot.llm.quality import held_out

BITS, GRAMS = 16, (1, 2, 3)
#: Bound of the sample: rows of each language. More languages than the second number are an error.
PER_LANGUAGE, MOST_LANGUAGES = 5000, 1000
#: Tasks that count the sample.
COUNTERS = 8
UNKNOWN = "und"


def _arrays(texts: list[str]) -> tv.Texts:
    return tv.code_points([t.lower() for t in texts])


@dataclass
class Model:
    """Languages in order, whole-number log-probabilities (languages x n-gram sizes x buckets) and log-priors."""

    languages: list[str]
    table: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior; ``und`` and 0 for a text without letters, or if nothing was learned."""
        arrays = _arrays(texts)
        total = np.zeros((len(texts), max(1, len(self.languages))))
        for g, n in enumerate(GRAMS):
            buckets, last = tv.ngrams(arrays.points, n, BITS), tv.ngram_ends(arrays, n)
            for k in range(len(self.languages)):
                total[:, k] += tv.sums_between(self.table[k, g][buckets], arrays.starts, last)
        total = total / tv.FIXED + (self.prior if self.languages else 0)
        best = np.argmax(total, axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        lettered = tv.sums_between(tv.letters(arrays.points), arrays.starts, arrays.ends) > 0
        known = lettered & bool(self.languages)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", learn=None, per_language: int = PER_LANGUAGE, smoothing: float = 0.5) -> Model:
    """A model of the rows with a language and text whose id meets ``learn`` (all ids, if none is given).

    About ``per_language`` rows of each language are drawn by a hash of the id;
    texts are whole.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if learn is None else learn))
    rows = known.groupBy(F.col(lang_col).alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = dict(sorted((r[0], r[1]) for r in rows))
    languages = list(counts)
    ticket = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 20))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col(lang_col) == lang) & (ticket < int(min(1.0, per_language / n) * (1 << 20))))
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang_col)) - 1 if languages else F.lit(0)
    sample = known.where(wanted).select(number.cast("int").alias("k"), F.col(text_col).alias("t")).repartition(COUNTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(languages), len(GRAMS), 1 << BITS), np.int64)
        for batch in batches:
            which = batch.column(0).to_numpy()
            for at, texts in chunks(batch.column(1).to_pylist()):
                arrays = _arrays(texts)
                of = np.repeat(which[at : at + len(texts)], arrays.ends - arrays.starts + 1)
                for g, n in enumerate(GRAMS):
                    buckets = tv.ngrams(arrays.points, n, BITS)
                    live = np.zeros(len(buckets) + 1, np.int64)
                    last = tv.ngram_ends(arrays, n)
                    some = last > arrays.starts
                    np.add.at(live, arrays.starts[some], 1)
                    np.add.at(live, last[some], -1)
                    inside = np.cumsum(live[:-1]) > 0
                    flat = np.bincount(of[: len(buckets)][inside].astype(np.int64) << BITS | buckets[inside], minlength=len(languages) << BITS)
                    held[:, g] += flat.reshape(len(languages), -1)
        k, g, b = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (k, g, b)] + [pa.array(held[k, g, b])], names=["k", "g", "b", "n"])

    table_ = np.zeros((len(languages), len(GRAMS), 1 << BITS))
    if languages:
        # at most languages x sizes x buckets rows
        got = sample.mapInArrow(count, "k int, g int, b int, n long").groupBy("k", "g", "b").agg(F.sum("n").alias("n")).toArrow()
        k, g, b, n = (got.column(i).to_numpy() for i in range(4))
        table_[k, g, b] = n
        table_ = np.log(table_ + smoothing) - np.log(table_.sum(axis=2, keepdims=True) + smoothing * (1 << BITS))
    prior = np.log(np.array(list(counts.values()), float) / max(1, sum(counts.values())))
    return Model(languages, np.round(table_ * tv.FIXED).astype(np.int32), prior)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; a null text is ``und``. Other columns pass through, a clash of names is an error."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(at).to_pylist()):
                lang, score = sent.value.predict(texts)
                yield with_columns(batch.slice(first, len(texts)), {"lang_pred": pa.array(lang, pa.string()), "lang_score": pa.array(score)})

    return docs.mapInArrow(run, schema_with(docs, "lang_pred string, lang_score double"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learn=~held_out(0, 5))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(0, 5), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
