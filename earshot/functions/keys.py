"""Keys: parsing of ids, seeds from ids, keyed random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_seed(key: Column, modulus: int = 10**8) -> Column:
    """The MD5 of a key as a number, modulo ``modulus``: the two 64-bit halves are reduced apart."""
    half = lambda at: F.conv(F.substring(F.md5(key), at, 16), 16, 10).cast("decimal(20,0)")
    shift = F.lit(2**64 % modulus)
    high = (half(1) % modulus).cast("long")
    low = (half(17) % modulus).cast("long")
    return (high * shift % modulus + low) % modulus


def seeded_unit(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) fixed by seed and keys, the same in every partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def seeded_order(seed: int, key: Column) -> Column:
    """A sort key of a seeded shuffle, as text, equal in other engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def signal_parts(key: Column) -> Column:
    """scene, listener and system of ``scene_listener_system``, the last of any number of parts; fewer than three are an error."""
    parts = F.split(key, "_")
    made = F.struct(parts[0].alias("scene"), parts[1].alias("listener"), F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "_").alias("system"))
    return F.when(F.size(parts) >= 3, made).otherwise(F.raise_error(F.concat(F.lit("not a signal name: "), key)))


def strict_parts(key: Column, count: int, sep: str = "_") -> Column:
    """Exactly ``count`` non-empty parts, else an error."""
    parts = F.split(key, sep)
    return F.when((F.size(parts) == count) & ~F.exists(parts, lambda p: p == ""), parts).otherwise(F.raise_error(F.concat(F.lit("cannot parse: "), key)))


def numbered(prefix: str, number: Column, digits: int = 5) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", number)


def split_of(number: Column) -> Column:
    """train, valid or test by ranges of a numeric id; the ranges leave their bounds to test."""
    return F.when((number > 0) & (number < 49999), "train").when((number > 50000) & (number < 59999), "valid").otherwise("test")
