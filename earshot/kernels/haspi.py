"""Speech intelligibility from modulation of the ear model's envelopes (HASPI, version 2).

Envelopes are smoothed and subsampled, turned into cepstra, filtered by ten
modulation bands, and correlated band by band. An ensemble of small networks
maps the ten correlations to a score. Its published weights are a parameter:
a JSON file with ``hidden`` (networks x 11 x 4) and ``output`` (networks x 5).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from earshot.kernels import ear

# Fixed values of the measure: cutoff of the envelopes in Hz, silence and dither in dB, cepstral coefficients, modulation
# bands' centres in Hz, length of the slowest band's filter in seconds, and the networks' greatest output.
CUTOFF, SILENCE_DB, DITHER_DB, COEFFICIENTS = 320.0, 2.5, 0.1, 6
CENTRES = (2.0, 6.0, 10.0, 16.0, 25.0, 40.0, 64.0, 100.0, 160.0, 256.0)
LONGEST_S, MOST = 0.24, 0.9508


def low_passed(db: np.ndarray, cutoff: float = CUTOFF, rate: float = ear.RATE) -> np.ndarray:
    """Envelopes (bands x samples) under a raised cosine, every so-many-th sample that leaves eight times the cutoff."""
    half = round(0.7 / cutoff * rate) // 2
    rise = 0.5 * (1 - np.cos(2 * np.pi * np.arange(1, half + 1) / (2 * half + 1)))
    window = np.concatenate([rise, rise[::-1]]) / (2 * rise.sum())
    smooth = np.apply_along_axis(lambda row: np.convolve(row, window)[half : half + len(row)], 1, db)
    return smooth[:, :: int(rate // (8 * cutoff))]


def cepstra(reference: np.ndarray, processed: np.ndarray, rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray] | None:
    """Centred coefficients (coefficients x samples) where the reference is heard, with dither; None for one sample or none."""
    loud = 20 * np.log10((10 ** (reference / 20)).mean(axis=0)) > SILENCE_DB
    if loud.sum() <= 1:
        return None
    basis = np.cos(np.outer(np.arange(COEFFICIENTS), np.arange(len(reference))) * np.pi / (len(reference) - 1))
    basis /= np.linalg.norm(basis, axis=1, keepdims=True)
    # noise is drawn samples first
    noisy = [v[:, loud] + DITHER_DB * rng.standard_normal((int(loud.sum()), len(v))).T for v in (reference, processed)]
    out = [np.einsum("cb,bt->ct", basis, v) for v in noisy]
    return out[0] - out[0].mean(axis=1, keepdims=True), out[1] - out[1].mean(axis=1, keepdims=True)


def modulation(x: np.ndarray, rate: float) -> np.ndarray:
    """Coefficients in each modulation band (bands x coefficients x samples): turned down, smoothed, turned up again."""
    edges = [0.0, 4.0, 8.0]
    for centre in CENTRES[2:]:
        edges.append(centre**2 / edges[-1])
    centres = CENTRES[: sum(e < rate / 2 for e in edges) - 1]
    n, out = np.arange(1, x.shape[1] + 1), []
    for k, centre in enumerate(centres):
        seconds = LONGEST_S if k < 2 else LONGEST_S * CENTRES[2] / centre
        half = int(seconds * rate / 2)
        window = np.hanning(2 * half + 1)
        window /= window.sum()
        turn = np.sqrt(2) * np.exp(-2j * np.pi * n * centre / rate) if k else np.ones(len(n), complex)
        down = np.apply_along_axis(lambda row, w=window, h=half: np.convolve(row, w)[h : h + len(row)], 1, x * turn)
        out.append(np.real(down * turn.conj()))
    return np.stack(out)


def correlations(reference: np.ndarray, processed: np.ndarray) -> np.ndarray:
    """Mean magnitude of the correlation over coefficients 1 to 5, by modulation band; 0 where a side is still."""
    x, y = (v - v.mean(axis=2, keepdims=True) for v in (reference, processed))
    a, b = (x**2).sum(axis=2), (y**2).sum(axis=2)
    still = (a < ear.SMALL) | (b < ear.SMALL)
    return np.where(still, 0, np.abs((x * y).sum(axis=2)) / np.sqrt(np.where(still, 1, a * b)))[:, 1:].mean(axis=1)


@dataclass(frozen=True)
class Networks:
    """One hidden layer of logistic nodes each; the first weight of a node is its constant."""

    hidden: np.ndarray
    output: np.ndarray
    most: float = MOST

    @staticmethod
    def read(path: str) -> Networks:
        with open(path) as file:
            data = json.load(file)
        return Networks(np.array(data["hidden"], float), np.array(data["output"], float).reshape(len(data["hidden"]), -1))

    def __call__(self, features: np.ndarray) -> float:
        logistic = lambda v: 1 / (1 + np.exp(-v))
        nodes = logistic(np.einsum("kih,i->kh", self.hidden, np.append(1, features)))
        return float(logistic(self.output[:, 0] + (self.output[:, 1:] * nodes).sum(axis=1)).mean() / self.most)


def features(reference: np.ndarray, processed: np.ndarray, rate: float, levels: np.ndarray, *, equalised: int = 0, level: float = 65.0, rng: np.random.RandomState) -> np.ndarray:
    """Correlations of the ten modulation bands; NaN where the reference is not heard."""
    x, y = ear.listen(reference, rate, processed, rate, levels, equalised=equalised, level=level, rng=rng)
    found = cepstra(low_passed(x.db), low_passed(y.db), rng)
    if found is None:
        return np.full(len(CENTRES), np.nan)
    return correlations(*(modulation(v, 8 * CUTOFF) for v in found))


def scored(pairs: DataFrame, *, rate: float, seed_col: str, networks: Networks | None = None, columns: tuple[str, str, str] = ("reference", "processed", "levels"), equalised: int = 0, level: float = 65.0) -> DataFrame:
    """``pairs`` with ``modulation`` (ten correlations) and ``haspi`` (null without networks); both null for null signals or levels, or an unheard reference."""
    places = [pairs.columns.index(c) for c in (*columns, seed_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, scores = [], []
            for x, y, levels, seed in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                known = x is not None and y is not None and levels is not None
                rng = np.random.RandomState((seed or 0) % 2**32)
                v = features(np.asarray(x, float), np.asarray(y, float), rate, np.asarray(levels, float), equalised=equalised, level=level, rng=rng) if known else np.array([np.nan])
                heard = not np.isnan(v).any()
                bands.append(v.tolist() if heard else None)
                scores.append(networks(v) if heard and networks else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bands, pa.list_(pa.float64())), pa.array(scores, pa.float64())], names=[*batch.schema.names, "modulation", "haspi"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields] + ["modulation array<double>, haspi double"])
    return pairs.mapInArrow(run, schema)
