"""Transcripts scored against what was said, over alternative forms of both."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.columns import fresh_names
from earshot.functions.text import best_forms, correctness, normalised, words


def _forms(df: DataFrame, column: str, contractions: Mapping[str, str] | None) -> Column:
    """The distinct-able forms of a text or an array of texts: normalised, as arrays of words; a null is one empty form."""
    texts = F.col(column)
    if df.schema[column].dataType.simpleString() == "string":
        texts = F.array(texts)
    each = lambda t: words(normalised(F.coalesce(t, F.lit("")), contractions=dict(contractions or {})))
    return F.transform(F.coalesce(texts, F.array(F.lit(""))), each)


def scored(df: DataFrame, reference: str, hypothesis: str, *, contractions: Mapping[str, str] | None = None, out: str = "score") -> DataFrame:
    """``df`` with ``out``: hits, substitutions, deletions and insertions of words, the places of the forms that they hold for, and ``correctness``.

    Both columns are texts or arrays of texts, of which the pair with the most
    hits counts, the first of equal ones. Equal pairs are aligned once, in tasks
    that share them evenly. Null texts are empty; correctness is null for a
    reference without words, and for an empty array.
    """
    r, h, found = fresh_names(df, "_reference", "_hypothesis", "_found")
    rows = df.withColumns({r: _forms(df, reference, contractions), h: _forms(df, hypothesis, contractions)})
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number, so that small rows are not merged into a few tasks
    pairs = rows.select(r, h).distinct().repartition(tasks, r, h)
    aligned = pairs.withColumn(found, best_forms(F.col(r), F.col(h)))
    aligned = aligned.withColumn(out, F.struct(f"{found}.*", correctness(F.col(found)).alias("correctness"))).drop(found)
    return rows.join(aligned, [r, h]).drop(r, h)
