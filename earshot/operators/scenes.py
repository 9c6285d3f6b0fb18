"""Scene tables: rooms in turn, keyed random draws, interferers. Every draw is a hash of the scene's key, so rows need no order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.draws import bounded_normal, open_unit
from earshot.functions.keys import md5_seed, numbered

#: What an interferer can be.
KINDS = ("speech", "nonspeech", "music")


def draw(key: Column, name: str, seed: int) -> Column:
    """A number from [0, 1) for a key and the name of what is drawn."""
    return md5_seed(F.concat_ws(":", F.lit(str(seed)), F.lit(name), key.cast("string"))) / 1e8


def uniform(key: Column, name: str, seed: int, low: float, high: float) -> Column:
    return low + draw(key, name, seed) * (high - low)


def chosen(key: Column, name: str, seed: int, options: Sequence) -> Column:
    """One of a few literal options."""
    at = F.floor(draw(key, name, seed) * len(options)).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), at + 1)


def bounded_gauss(key: Column, name: str, seed: int, spread: float, bound: float) -> Column:
    """A normal draw, given that it lies within the bound."""
    return bounded_normal(open_unit(key, name, seed), spread, bound)


def build_scenes(targets: DataFrame, key: str, *, seed: int, snr: tuple[float, float] = (-12.0, 6.0), most_interferers: int = 3, rate: int = 44100, pre_s: float = 2.0) -> DataFrame:
    """``targets`` with a scene each.

    Columns added: ``snr``, ``n_interferers`` (1 to the most), ``interferers`` (position, kind, time_start in
    samples, rising by position), ``rotation`` (start and end angle in degrees), ``target_start`` in samples.
    """
    k = F.col(key)
    count = F.floor(uniform(k, "n", seed, 1, most_interferers + 1)).cast("int")

    def interferer(i: int) -> Column:
        return F.struct(
            F.lit(i + 1).alias("position"), chosen(k, f"kind{i}", seed, KINDS).alias("kind"), F.rint(uniform(k, f"start{i}", seed, 0, pre_s) * rate).cast("int").alias("time_start")
        )

    start, turn = uniform(k, "angle", seed, -30, 30), bounded_gauss(k, "turn", seed, 7.5, 22.5)
    return targets.withColumns(
        {
            "snr": F.round(uniform(k, "snr", seed, *snr), 4),
            "n_interferers": count,
            "interferers": F.slice(F.array(*[interferer(i) for i in range(most_interferers)]), F.lit(1), count),
            "rotation": F.struct(F.round(start, 4).alias("start"), F.round(start + turn, 4).alias("end")),
            "target_start": F.lit(int(pre_s * rate)),
        }
    )


def named(scenes: DataFrame, number: str, prefix: str = "S", out: str = "scene") -> DataFrame:
    return scenes.withColumn(out, numbered(prefix, F.col(number)))


def angle(origin: Column, point: Column) -> Column:
    """Degrees from one position (x, y, ...) to another."""
    return F.degrees(F.atan2(F.get(point, 1) - F.get(origin, 1), F.get(point, 0) - F.get(origin, 0)))


def sample_delay(one: Column, two: Column, rate: int = 44100, speed: float = 344.0) -> Column:
    """Whole samples that sound takes between two positions."""
    gaps = F.zip_with(one, two, lambda a, b: (a - b) * (a - b))
    return F.floor(F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)) / speed * rate).cast("int")
