"""Small forms of levels, gains and labels as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.arrays import let, mean, rms

# Levels in dB HL at the standard frequencies for three degrees of hearing loss.
STANDARD_LOSS = {
    "Mild": (10, 15, 19, 25, 28, 31, 35, 38),
    "Moderate": (20, 20, 25, 35, 40, 45, 50, 55),
    "Moderately severe": (19, 28, 40, 52, 56, 58, 58, 63),
}


def standard_levels(degree: Column) -> Column:
    """Levels of a degree of hearing loss; an unknown degree is an error, a null one null."""
    table = F.create_map(*[x for name, levels in STANDARD_LOSS.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in levels]))])
    found = F.try_element_at(table, degree)
    return F.when(degree.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("no standard levels for "), degree))).otherwise(found)


def class_index(label: Column, labels: Sequence[str]) -> Column:
    """The place of a label among ``labels``; their number for any other, null included."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))]), label), F.lit(len(labels)))


def mean_of_map(scores: Column) -> Column:
    """Mean of a map's values; null for an empty map or one with a null."""
    values = F.map_values(scores)
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def target_loudness(loss: Column, average: float, least: float) -> Column:
    """``average`` below a mean loss of 50 dB; from there on ``least``, a fifth of a dB less for each dB beyond."""
    return F.when(loss >= 50, F.lit(least) - F.greatest((loss - 50) / 5, F.lit(0.0))).otherwise(F.lit(average))


def reference_level(level_rms: Column) -> Column:
    """The level that an RMS of 1 stands for, if a signal of this RMS is to be at 65 dB."""
    return F.when(level_rms > 0, 65 - 20 * F.log10(level_rms))


def mean_gain_undone(gains_db: Column) -> Column:
    """The gain in dB that undoes the mean energy gain of several."""
    power = F.aggregate(gains_db, F.lit(0.0), lambda s, g: s + F.pow(F.lit(10.0), g / 10))
    return F.when(F.size(gains_db) > 0, -10 * F.log10(power / F.size(gains_db)))


def smoothstep(x: Column, low: Column | float = 0.0, high: Column | float = 1.0, order: int = 1) -> Column:
    """A polynomial from 0 at ``low`` to 1 at ``high``, flat to the ``order``-th derivative at both."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))

    def curve(t: Column) -> Column:
        factors = [comb(order + n, n) * comb(2 * order + 1, order - n) * (-1) ** n for n in range(order + 1)]
        total = F.lit(float(factors[-1]))
        for factor in reversed(factors[:-1]):
            total = total * t + factor
        for _ in range(order + 1):
            total = total * t
        return total

    return let(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)), curve)


def rotation_indices(length: int, start: Column, end: Column, order: int = 1) -> Column:
    """For each of ``length`` samples, how far a turn from ``start`` to ``end`` has come, as a whole number below ``length``; a bad range is an error."""
    at = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.floor(smoothstep(i.cast("double"), start.cast("double"), end.cast("double"), order) * (length - 1)).cast("int"))
    return F.when((start > end) | (end > length), F.raise_error(F.lit("a turn must start before it ends, within the signal"))).otherwise(at)


def looked_up(table: Column, indices: Column) -> Column:
    """The entries of ``table`` at ``indices`` (from 0); an index beyond it is an error."""
    return F.transform(indices, lambda i: F.element_at(table, i + 1))


def turn_angles(indices: Column, length: int, first: Column, last: Column) -> Column:
    """The angle at each sample of a turn from ``first`` to ``last`` by ``rotation_indices``: steps of a table of ``length`` equal ones."""
    table = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: first + (last - first) * i / (length - 1))
    return let(table, lambda t: looked_up(t, indices))


def remixed(vocals: Column, accompaniment: Column, beta: Column) -> Column:
    """Vocals at ``beta ** 2 + 1`` and accompaniment at two less that."""
    return F.zip_with(vocals, accompaniment, lambda v, a: v * (beta * beta + 1) + a * (2 - (beta * beta + 1)))


def at_level_of(signal: Column, own: Column, wanted: Column) -> Column:
    """``signal`` times the ratio of the RMS of ``wanted`` to that of ``own``; null where ``own`` is silent."""
    return let(F.when(rms(own) > 0, rms(wanted) / rms(own)), lambda k: F.transform(signal, lambda v: v * k))


def strict_zip(one: Column, two: Column) -> Column:
    """Pairs of two arrays of one length; else an error."""
    return F.when(F.size(one) == F.size(two), F.zip_with(one, two, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.raise_error(F.lit("arrays differ in length")))


def keyed_number(key: Column, below: Column | int) -> Column:
    """A whole number from 0 to ``below`` - 1 that a key fixes, the same in other engines: eight hexadecimal digits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), below if isinstance(below, Column) else F.lit(below))


def cropped(signal: Column, length: int, key: Column, silence: int = 0) -> Column:
    """``length`` samples from a place that the key fixes, after ``silence`` samples; a shorter rest is filled with zeros at its end."""
    room = F.greatest(F.size(signal) - silence - length + 1, F.lit(1))
    part = F.slice(signal, (keyed_number(key, room) + silence + 1).cast("int"), F.lit(length))
    return F.concat(part, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(part)))


def shared_gains(gains: Column, labels: Column) -> Column:
    """Gains of sources; those whose label another source has too get the mean over all such sources, whatever their label."""
    twice = lambda label: F.size(F.filter(labels, lambda other: other.eqNullSafe(label))) > 1
    pairs = F.zip_with(gains, F.transform(labels, twice), lambda g, t: F.struct(g.alias("gain"), t.alias("twice")))
    return let(pairs, lambda p: let(mean(F.transform(F.filter(p, lambda s: s["twice"]), lambda s: s["gain"])), lambda m: F.transform(p, lambda s: F.when(s["twice"], m).otherwise(s["gain"]))))


def best_of_ears(left: Column, right: Column, left_reference: Column, right_reference: Column, score: Callable[[Column, Column], Column]) -> Column:
    """The greatest of the four scores of either ear against either reference; null only if all are."""
    return F.greatest(*[score(reference, ear) for reference in (left_reference, right_reference) for ear in (left, right)])


def delayed_references(left: Column, right: Column, left_delay: Column, right_delay: Column) -> Column:
    """Both references later by so many samples each, with zeros to the length of the later one: fields left and right."""
    most = F.greatest(left_delay, right_delay)
    late = lambda x, by: F.concat(F.array_repeat(F.lit(0.0), by), x, F.array_repeat(F.lit(0.0), most - by))
    return F.struct(late(left, left_delay).alias("left"), late(right, right_delay).alias("right"))
