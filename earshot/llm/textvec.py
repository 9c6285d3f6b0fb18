"""Texts as arrays: code points of many texts at once, hashed character n-grams and words.

Every function is deterministic and works on whole texts; sums over n-grams use
whole numbers (``FIXED`` units to one), so a text's score does not depend on the
texts beside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Units to one in whole-number tables.
FIXED = 1 << 20

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


@dataclass
class Texts:
    """Code points of texts, each followed by a 0; text i is ``points[starts[i]:ends[i]]``."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def code_points(texts: list[str]) -> Texts:
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    return Texts(points, ends - lengths, ends)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def _letters_digits() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def letters(points: np.ndarray) -> np.ndarray:
    return _letters()[points]


def letters_digits(points: np.ndarray) -> np.ndarray:
    return _letters_digits()[points]


def not_space(points: np.ndarray) -> np.ndarray:
    return (points != 0x20) & ((points < 9) | (points > 13)) & (points != 0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def ngrams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each code point (the last n - 1 have none)."""
    h = points.astype(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(n)
    plain = h
    for j in range(1, n):
        h = h[:-1] * np.uint32(0x01000193) + plain[j:]
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return (h ^ h >> np.uint32(13)) >> np.uint32(32 - bits)


def ngram_ends(texts: Texts, n: int) -> np.ndarray:
    """Where each text's last n-gram begins, plus one; not before the text itself."""
    return np.maximum(texts.ends - n + 1, texts.starts)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _INVERSE)):
            full = np.full(max(n, 1 << 20), base, np.uint64)
            full[0] = 1
            _powers[i] = np.cumprod(full)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Runs of chosen code points: where they begin and end, their 64-bit hashes, and each text's first (with the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(texts: Texts, chosen: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """A run's hash is a polynomial in its code points, taken from prefix sums of all.

    With ``prefixes``, ``hashes`` has a further column for each: the hash of the
    run's first so many code points (of the whole run, if it is shorter).
    """
    change = np.diff(chosen.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    up, down = _power(len(texts.points) + 1)
    sums = np.zeros(len(texts.points) + 1, np.uint64)
    np.cumsum((texts.points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    for n in prefixes:
        part = mixed((sums[np.minimum(starts + n, ends)] - sums[starts]) * down[starts] + np.uint64(n))
        hashes = np.column_stack([hashes, part])
    return Words(starts, ends, hashes, np.append(np.searchsorted(starts, texts.starts), len(starts)))


def sums_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Exact sums of ``values[first:last]`` of whole numbers, 0 where empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.where(last > first, total[np.minimum(last, len(values))] - total[np.minimum(first, len(values))], 0)
