"""Envelopes compared segment by segment, as intelligibility measures do: sliding windows, the processed one brought to the level of the clean one and clipped, correlated over active frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.arrays import let

EPS = 1e-8


def _sum(rows: Column, of) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + of(r))


def segment_match(clean: Column, processed: Column, n: int, *, clip_db: float | None = -15.0, active: Column | None = None) -> Column:
    """Mean correlation of two envelopes over all windows of ``n`` frames, -1 to 1.

    In each window the processed envelope is scaled to the clean one's norm and,
    with ``clip_db``, kept below the clean one raised by that distortion. Means,
    norms and sums run over frames that are ``active`` (an array of 0 and 1; all, if
    none is given), and windows weigh by their active frames. Null where there is
    no whole window or no active frame; envelopes of different lengths end with
    the shorter.
    """
    one = F.transform(clean, lambda _: F.lit(1.0)) if active is None else F.transform(active, lambda m: m.cast("double"))
    rows = F.zip_with(F.zip_with(clean, processed, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))), one, lambda p, m: F.struct(p["a"].alias("a"), p["b"].alias("b"), m.alias("m")))
    whole = F.filter(rows, lambda r: r["a"].isNotNull() & r["b"].isNotNull() & r["m"].isNotNull())

    def window(w: Column) -> Column:
        norm = lambda c: F.sqrt(_sum(w, lambda r: r[c] * r[c] * r["m"] * r["m"]))
        limit = None if clip_db is None else 1 + 10 ** (-clip_db / 20)

        def levelled(gain: Column) -> Column:
            scaled = lambda r: r["b"] * gain if limit is None else F.least(r["b"] * gain, r["a"] * limit)
            return F.transform(w, lambda r: F.struct(r["a"].alias("a"), scaled(r).alias("b"), r["m"].alias("m")))

        return let(levelled(norm("a") / (norm("b") + EPS)), correlation)

    def correlation(w: Column) -> Column:
        mean = lambda c: _sum(w, lambda r: r[c] * r["m"]) / (_sum(w, lambda r: r["m"]) + EPS)
        means = F.struct(mean("a").alias("a"), mean("b").alias("b"))

        def about(at: Column) -> Column:
            off = lambda c: lambda r: (r[c] - at[c]) * r["m"]
            length = lambda c: F.sqrt(_sum(w, lambda r: off(c)(r) * off(c)(r)))
            return _sum(w, lambda r: (r["a"] - at["a"]) * (r["b"] - at["b"]) * r["m"]) / ((length("a") + EPS) * (length("b") + EPS))

        return F.struct(let(means, about).alias("c"), _sum(w, lambda r: r["m"]).alias("m"))

    def over(all_rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_rows) - n + 1)
        found = F.transform(starts, lambda i: let(F.slice(all_rows, i, F.lit(n)), window))
        return let(found, lambda f: F.when(_sum(f, lambda r: r["m"]) > 0, _sum(f, lambda r: r["c"]) / (_sum(f, lambda r: r["m"]) / n + EPS)))

    return let(whole, lambda all_rows: F.when(F.size(all_rows) >= n, over(all_rows)))
