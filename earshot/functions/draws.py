"""Keyed random draws in closed form: normal ones within bounds, and weighted ones without replacement. Every draw follows from its key."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.keys import md5_seed

# The published rational approximation of the normal quantile to 16 digits, near the middle, in the tails and far out; numerators, then denominators.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: Seeds are whole numbers below this; a draw lies in the middle of its step, so that it is neither 0 nor 1.
STEPS = 10**8


def open_unit(key: Column, name: str, seed: int) -> Column:
    """A number within (0, 1) for a key and the name of what is drawn."""
    return (md5_seed(F.concat_ws(":", F.lit(str(seed)), F.lit(name), key.cast("string")), STEPS) + 0.5) / STEPS


def _ratio(x: Column, of: tuple[Sequence[float], Sequence[float]]) -> Column:
    def polynomial(factors: Sequence[float]) -> Column:
        total = F.lit(factors[-1])
        for f in factors[-2::-1]:
            total = total * x + F.lit(f)
        return total

    return polynomial(of[0]) / polynomial(of[1])


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a number within (0, 1); null elsewhere."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(r - 1.6, TAIL)).otherwise(_ratio(r - 5.0, FAR))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _ratio(F.lit(0.180625) - q * q, MIDDLE)).when(q < 0, -tail).otherwise(tail))


def bounded_normal(unit: Column, spread: float, bound: float) -> Column:
    """A normal draw of standard deviation ``spread``, given that it lies within plus or minus ``bound``, from a number within (0, 1)."""
    low = NormalDist().cdf(-bound / spread)
    return normal_quantile(F.lit(low) + unit * (1 - 2 * low)) * spread


def weighted_order(unit: Column, weight: Column) -> Column:
    """A sort key, least first, by which a row comes before others as its weight to theirs; null for a weight that is not above 0.

    The first so many rows are a weighted draw without replacement.
    """
    return F.when(weight > 0, -F.ln(unit) / weight)
