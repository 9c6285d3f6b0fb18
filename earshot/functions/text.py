"""Transcripts: normalisation as column expressions, number words and word alignment as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Number words.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = ((10**9, "billion"), (10**6, "million"), (1000, "thousand"))

# Symbols that are taken out, marks of speech recognisers, and what counts as a token.
SYMBOLS = "[;!*#,.′’‘_()]"
NON_WORDS = r"[<\[][^>\]]*[>\]]"
TOKEN = r"[a-z]+(?:'[a-z]+)*'?|'[a-z]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"


def spoken(number: str) -> str:
    """A whole or decimal number in words, without "and" and hyphens; anything else stays."""
    whole, point, part = number.partition(".")
    if not whole.isdigit() or (point and not part.isdigit()):
        return number

    def say(n: int) -> str:
        if n < 20:
            return ONES[n]
        if n < 100:
            return TENS[n // 10] + (f" {ONES[n % 10]}" if n % 10 else "")
        if n < 1000:
            return f"{ONES[n // 100]} hundred" + (f" {say(n % 100)}" if n % 100 else "")
        for size, name in SCALES:
            if n >= size:
                left, rest = divmod(n, size)
                joint = " " if rest < 100 else ", "
                return f"{say(left)} {name}" + (f"{joint}{say(rest)}" if rest else "")
        raise AssertionError(n)

    if int(whole) >= 10**12:
        return " ".join(ONES[int(d)] for d in whole)
    return say(int(whole)) + (" point " + " ".join(ONES[int(d)] for d in part) if part else "")


def with_numbers_spoken(text: str) -> str:
    """``text`` with its decimals, and whole numbers that stand alone, in words."""
    return re.sub(r"\b\d+\b", lambda m: spoken(m.group()), re.sub(r"\d+\.\d+", lambda m: spoken(m.group()), text))


def _numbers_spoken(text: pd.Series) -> pd.Series:
    return text.str.replace(r"\d+(?:\.\d+)?", lambda m: spoken(m.group()), regex=True)


def numbers_spoken(text: Column) -> Column:
    """Text with its numbers in words; null stays null."""
    return F.pandas_udf(_numbers_spoken, "string")(text)


def read_contractions(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of ``word,written out`` lines, in lower case; of several lines for a word the first counts, and nothing is written for a word alone."""
    out: dict[str, str] = {}
    for (line,) in spark.read.text(path).collect():  # a dictionary: a few hundred lines
        word, _, written = line.strip().partition(",")
        out.setdefault(word.strip().lower(), written.strip().lower())
    return out


def expanded(text: Column, contractions: dict[str, str]) -> Column:
    """Tokens of a text in lower case, those of a table of contractions written out. Digits and other letters than a to z are no tokens."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if contractions:
        table = F.create_map(*[F.lit(x) for pair in contractions.items() for x in pair])
        tokens = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(tokens, " ")


def normalised(text: Column, *, contractions: dict[str, str] | None = None) -> Column:
    """Symbols away, contractions written out, numbers in words, recognisers' marks away, upper case, single spaces, in this order.

    Digits of the text itself are no tokens and leave, so numbers can only come
    from what a table writes out, and are put into words there.
    """
    table = {word: with_numbers_spoken(written) for word, written in (contractions or {}).items()}
    text = expanded(F.regexp_replace(text, SYMBOLS, ""), table)
    return F.trim(F.regexp_replace(F.upper(F.regexp_replace(text, NON_WORDS, "")), r"\s+", " "))


def words(text: Column) -> Column:
    """Words of normalised text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


#: Numbers that the tables of one batch of alignments hold in a row at most; a longer pair is a batch by itself.
CELLS = 1 << 18


def align_many(references: Sequence[np.ndarray], hypotheses: Sequence[np.ndarray]) -> np.ndarray:
    """Hits, substitutions, deletions and insertions of a least-cost alignment of each pair of sequences of word numbers (0 or more).

    Pairs of like length are aligned together: a step takes one word of every
    reference, a row of the dynamic program for each pair, and insertions along a
    row are a running minimum. Of alignments with equal cost the one with the most
    hits counts.
    """
    n_r, n_h = (np.array([len(x) for x in side], np.int64) for side in (references, hypotheses))
    # cost and hits in one number: cost first, then more hits
    unit, last = n_r + n_h + 1, np.zeros(len(n_r), np.int64)
    bucket = np.floor(np.log(n_h + 8) / np.log(1.25))  # lengths in one differ by a quarter at most
    like = np.lexsort((n_r, bucket))
    at = 0
    while at < len(like):
        same = np.searchsorted(bucket[like], bucket[like[at]], side="right")
        some = like[at : min(same, at + max(1, CELLS // int(n_h[like[at]] * 1.25 + 10)))]
        at += len(some)
        r, h = (np.full((len(some), int(n[some].max())), fill) for n, fill in ((n_r, -2), (n_h, -1)))
        for i, pair in enumerate(some.tolist()):
            r[i, : n_r[pair]], h[i, : n_h[pair]] = references[pair], hypotheses[pair]
        step = unit[some][:, None]
        ramp = np.arange(h.shape[1] + 1)[None, :] * step
        row, end, size_h = ramp.copy(), n_r[some], n_h[some]
        for word in range(r.shape[1] + 1):
            here = np.flatnonzero(end == word)
            last[some[here]] = row[here, size_h[here]]
            if word < r.shape[1]:
                best = row + step
                np.minimum(best[:, 1:], row[:, :-1] + np.where(h == r[:, word : word + 1], -1, step), out=best[:, 1:])
                row = np.minimum.accumulate(best - ramp, axis=1) + ramp
    cost = -(-last // unit)
    hits = cost * unit - last
    # cost = S + D + I, reference = hits + S + D, hypothesis = hits + S + I
    subs = n_r + n_h - 2 * hits - cost
    return np.stack([hits, subs, n_r - hits - subs, n_h - hits - subs], axis=1)


def align(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """``align_many`` for one pair of lists of words."""
    r, h = _numbered([reference, hypothesis])
    return tuple(align_many([r], [h])[0].tolist())


def _numbered(lists: list[Sequence[str]]) -> list[np.ndarray]:
    """Lists of words as numbers, equal words by the same one."""
    flat, _ = pd.factorize(np.array([w for words in lists for w in words], object))
    return np.split(flat, np.cumsum([len(x) for x in lists])[:-1]) if lists else []


def _align_words(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    sides = _numbered([x for pair in zip(reference, hypothesis, strict=True) for x in ([] if w is None else w for w in pair)])
    return pd.DataFrame(align_many(sides[::2], sides[1::2]), columns=["hits", "substitutions", "deletions", "insertions"], dtype="int32")


def align_words(reference: Column, hypothesis: Column) -> Column:
    """Counts of a word alignment of two arrays of words; a null array is an empty one."""
    return F.pandas_udf(_align_words, "hits int, substitutions int, deletions int, insertions int")(reference, hypothesis)


def _best_forms(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
    pairs, owners, forms = [], [], []
    for i, (r, h) in enumerate(zip(references, hypotheses, strict=True)):
        for b, hypothesis in enumerate(h):
            for a, reference in enumerate(r):
                pairs.append((reference, hypothesis))
                owners.append(i)
                forms.append((a, b))
    sides = _numbered([x for pair in pairs for x in pair]) if pairs else []
    counts = align_many(sides[::2], sides[1::2])
    out = pd.DataFrame({"hits": 0, "substitutions": 0, "deletions": 0, "insertions": 0, "reference": None, "hypothesis": None}, index=range(len(references)), dtype=object)
    if pairs:
        owners, forms = np.array(owners), np.array(forms)
        order = np.lexsort((np.arange(len(owners)), -counts[:, 0], owners))  # most hits, then the first
        first = order[np.r_[True, owners[order][1:] != owners[order][:-1]]]
        out.iloc[owners[first]] = np.concatenate([counts[first], forms[first]], axis=1)
    return out.astype("Int32")


BEST = "hits int, substitutions int, deletions int, insertions int, reference int, hypothesis int"


def best_forms(references: Column, hypotheses: Column) -> Column:
    """Of all forms of a reference and of a hypothesis (arrays of arrays of words), the counts of the pair with the most hits.

    ``reference`` and ``hypothesis`` are its places. Pairs go by hypothesis, then
    by reference; the first of equal ones counts. Without forms the counts are 0
    and the places null.
    """
    return F.pandas_udf(_best_forms, BEST)(references, hypotheses)


def correctness(counts: Column) -> Column:
    """hits / words of the reference; null if it has none."""
    return F.try_divide(counts["hits"], counts["hits"] + counts["substitutions"] + counts["deletions"])
