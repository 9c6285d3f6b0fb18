"""Logistic fits by least squares from histograms that add and subtract.

The range of x is cut into cells of equal width with a few Chebyshev nodes each.
A row lends its weight, and its y, to the nodes of its cell by Lagrange's
polynomials, so that a sum of any smooth function over rows is the same sum over
nodes. Such histograms are additive: groups are summed before they are shuffled,
and the histogram of all rows that differ from a given one in every key is the
total less those of the keys, by inclusion and exclusion. No rows are paired or
gathered, and x is not rounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from numpy.polynomial import Polynomial
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.storage import checkpointed

#: Cells of the range of x, and nodes of a cell.
CELLS, NODES = 64, 6
#: Fits that a task works on at once, and the most steps of one.
BATCH, STEPS = 256, 300
START = (0.5, 1.0)


def logistic(x: Column, x0: Column, k: Column) -> Column:
    return 100 / (1 + F.exp(-k * (x - x0)))


def node_places(nodes: int = NODES) -> np.ndarray:
    """Chebyshev's nodes within -1 to 1."""
    return np.cos(np.pi * (2 * np.arange(nodes) + 1) / (2 * nodes))


def _shares(u: Column, nodes: int) -> list[Column]:
    """How much a row at ``u`` in its cell lends to each node."""
    places = node_places(nodes)
    out = []
    for q, at in enumerate(places):
        others = np.delete(places, q)
        terms = (Polynomial.fromroots(others) / np.prod(at - others)).coef
        share = F.lit(float(terms[-1]))
        for c in terms[-2::-1]:
            share = share * u + F.lit(float(c))
        out.append(share)
    return out


def histogram(df: DataFrame, x: str, y: str, by: Sequence[str], span: tuple[float, float], *, cells: int = CELLS, nodes: int = NODES) -> DataFrame:
    """For each group and cell: ``sums``, the weights of its nodes, then their weighted y. Rows without x or y are left out."""
    low, high = span
    width = (high - low) / cells or 1.0
    cell = F.least(F.floor((F.col(x).cast("double") - F.lit(low)) / F.lit(width)), F.lit(cells - 1)).cast("int")
    u = (F.col(x).cast("double") - F.lit(low) - F.col("_cell") * F.lit(width)) / F.lit(width) * 2 - 1
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, cell.alias("_cell"), F.col(x), F.col(y).cast("double").alias("_y")).withColumn("_u", u)
    shares = _shares(F.col("_u"), nodes)
    return rows.groupBy(*by, "_cell").agg(F.array(*[F.sum(s) for s in shares], *[F.sum(s * F.col("_y")) for s in shares]).alias("_sums"))


def _added(cells: DataFrame, by: Sequence[str], length: int) -> DataFrame:
    """Histograms of coarser groups."""
    return cells.groupBy(*by, "_cell").agg(F.array(*[F.sum(F.get("_sums", i)) for i in range(length)]).alias("_sums"))


def node_grid(span: tuple[float, float], cells: int = CELLS, nodes: int = NODES) -> np.ndarray:
    """The x of every node of every cell."""
    low, high = span
    width = (high - low) / cells or 1.0
    return (low + width * (np.arange(cells)[:, None] + (node_places(nodes)[None, :] + 1) / 2)).ravel()


def fit_weighted(x: np.ndarray, weight: np.ndarray, total: np.ndarray, start: tuple[float, float] = START, steps: int = STEPS) -> np.ndarray:
    """x0 and k of 100 / (1 + exp(-k (x - x0))) by least squares for each row of ``weight`` and ``total`` (weighted y) over the nodes ``x``.

    All fits take their Levenberg-Marquardt steps together, each with its own
    damping, until none gains. A fit without weight is NaN.
    """
    p = np.tile(np.array(start, float), (len(weight), 1))
    damp = np.full(len(p), 1e-2)
    curve = lambda p: 100 / (1 + np.exp(np.clip(-p[:, 1:] * (x[None, :] - p[:, :1]), -500, 500)))
    cost = lambda f, w, v: (w * f * f - 2 * v * f).sum(axis=1)  # noqa: E731  less the squares of y, which do not change
    now = cost(curve(p), weight, total)
    open_ = np.flatnonzero(np.abs(weight).sum(axis=1) > 1e-9)
    for _ in range(steps):
        if not len(open_):
            break
        w, v, q = weight[open_], total[open_], p[open_]
        f = curve(q)
        slope = f * (1 - f / 100)
        by_x0, by_k = -q[:, 1:] * slope, (x[None, :] - q[:, :1]) * slope
        left = v - w * f
        g0, g1 = (by_x0 * left).sum(axis=1), (by_k * left).sum(axis=1)
        h00, h01, h11 = ((a * b * w).sum(axis=1) for a, b in ((by_x0, by_x0), (by_x0, by_k), (by_k, by_k)))
        a, d = h00 * (1 + damp[open_]) + 1e-12, h11 * (1 + damp[open_]) + 1e-12
        det = a * d - h01 * h01
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.stack([d * g0 - h01 * g1, a * g1 - h01 * g0], axis=1) / det[:, None]
        step = np.where(np.isfinite(step), step, 0)
        trial = cost(curve(q + step), w, v)
        better = trial < now[open_]
        at = open_[better]
        gain = now[at] - trial[better]
        p[at], now[at] = (q + step)[better], trial[better]
        damp[at] /= 3
        damp[open_[~better]] *= 4
        still = np.ones(len(open_), bool)
        still[better] = gain > 1e-14 * np.maximum(np.abs(now[at]), 1e-12)
        still[~better] = damp[open_[~better]] <= 1e12
        open_ = open_[still]
    p[np.abs(weight).sum(axis=1) <= 1e-9] = np.nan
    return p


def _fitted(histograms: DataFrame, keys: Sequence[str], signs: dict[str, float], base: np.ndarray, span: tuple[float, float], cells: int, nodes: int) -> DataFrame:
    """``keys`` with n, x0 and k of the histogram that is ``base`` plus the columns of ``signs`` by their signs."""
    x, places = node_grid(span, cells, nodes), cells * nodes
    few = len(keys)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                held = np.tile(base, (some.num_rows, 1, 1))  # row, cell, sums
                for column, sign in zip(some.columns[few:], signs.values(), strict=True):
                    rows = np.repeat(np.arange(some.num_rows), column.fill_null([]).value_lengths().to_numpy())
                    flat = column.flatten()
                    cell, sums = flat.field("_cell").to_numpy(), flat.field("_sums").flatten().to_numpy().reshape(-1, 2 * nodes)
                    np.add.at(held, (rows, cell), sign * sums)
                weight, total = held[:, :, :nodes].reshape(-1, places), held[:, :, nodes:].reshape(-1, places)
                n = np.rint(weight.sum(axis=1)).astype(np.int64)
                weight[n == 0], total[n == 0] = 0, 0  # what subtraction has left of nothing
                found = fit_weighted(x, weight, total)
                new = [pa.array(n), *(pa.array(found[:, i], mask=n == 0) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([*some.columns[:few], *new], names=[*keys, "n", "x0", "k"])

    kinds = {f.name: f.dataType.simpleString() for f in histograms.schema.fields}
    return histograms.select(*keys, *signs).mapInArrow(fit, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "n long, x0 double, k double"]))


def _span(df: DataFrame, x: str, y: str) -> tuple[float, float] | None:
    low, high = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(F.col(x).cast("double")), F.max(F.col(x).cast("double"))).first()
    return None if low is None else (low, high)


def logistic_by(df: DataFrame, x: str, y: str, by: Sequence[str], *, cells: int = CELLS, nodes: int = NODES) -> DataFrame:
    """n, x0 and k for each group, null groups too; a group without whole pairs of x and y has no row.

    A curve that rises within less than a cell needs more ``cells``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    span = _span(df, x, y)
    if span is None:
        return df.sparkSession.createDataFrame([], ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long, x0 double, k double"]))
    cut = histogram(df, x, y, by, span, cells=cells, nodes=nodes)
    whole = cut.groupBy(*by).agg(F.collect_list(F.struct("_cell", "_sums")).alias("_all"))  # no more than ``cells`` rows a group
    return _fitted(whole, by, {"_all": 1.0}, np.zeros((cells, 2 * nodes)), span, cells, nodes)


def disjoint_fits(df: DataFrame, x: str, y: str, keys: Sequence[str], *, cells: int = CELLS, nodes: int = NODES) -> DataFrame:
    """For each distinct tuple of ``keys``: n, x0 and k over the rows that differ from it in every key.

    Null keys equal each other. No such rows: n is 0, x0 and k are null. Tuples of
    rows without x or y are there too.
    """
    names = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    tuples = df.select(*names).distinct()
    span = _span(df, x, y)
    if span is None:
        return tuples.withColumns({"n": F.lit(0).cast("long"), "x0": F.lit(None).cast("double"), "k": F.lit(None).cast("double")})
    fine = checkpointed(histogram(df, x, y, names, span, cells=cells, nodes=nodes))
    base = np.zeros((cells, 2 * nodes))
    for r in _added(fine, [], 2 * nodes).collect():  # a row for each cell
        base[r["_cell"]] += r["_sums"]
    signs = {}
    for size in range(1, len(names) + 1):
        for some in combinations(names, size):
            column = f"_less{len(signs)}"
            signs[column] = -1.0 if size % 2 else 1.0
            coarse = _added(fine, some, 2 * nodes) if size < len(names) else fine
            group = coarse.groupBy(*some).agg(F.collect_list(F.struct("_cell", "_sums")).alias(column)).withColumnsRenamed({c: f"_{c}" for c in some})
            match = None
            for c in some:
                here = tuples[c].eqNullSafe(group[f"_{c}"])
                match = here if match is None else match & here
            tuples = tuples.join(group, match, "left").drop(*[f"_{c}" for c in some])
    return _fitted(tuples.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names], *signs), names, signs, base, span, cells, nodes)


def disjoint_predictions(df: DataFrame, x: str, y: str, keys: Sequence[str], *, cells: int = CELLS, nodes: int = NODES, out: str = "predicted") -> DataFrame:
    """Each row with ``n_train`` and ``out``: its x under a logistic map fitted to the rows that differ from it in every key; null without such rows or x."""
    fits = disjoint_fits(df, x, y, keys, cells=cells, nodes=nodes).withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)} | {"n": "n_train", "x0": "_x0", "k": "_k"})
    match = None
    for i, c in enumerate(keys):
        here = df[c].eqNullSafe(fits[f"_k{i}"])
        match = here if match is None else match & here
    return df.join(fits, match).withColumn(out, logistic(F.col(x).cast("double"), F.col("_x0"), F.col("_k"))).drop("_x0", "_k", *[f"_k{i}" for i in range(len(keys))])
