"""Windows over signals in long form: one row per sample, ordered within its signal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from earshot.columns import fresh_names, same_keys
from earshot.functions import gating
from earshot.functions.arrays import energy, frames
from earshot.storage import checkpointed


#: Rows of one signal that a task takes. A longer one is cut into blocks of as many, each with the rows before it that its windows reach.
LONGEST = 1 << 20


def _is_long(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether any signal has more than ``LONGEST`` rows; rows are counted before they are shuffled."""
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > LONGEST


def _numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Rows numbered from 0 within their signal, by ranges of signals and order: no task holds a signal.

    The ranges come from a sample, so the partitioned rows are stored before they
    are counted. A signal goes on from a range into the next, so a range has one
    signal at most that began before it.
    """
    part, before, here, *names = fresh_names(df, "_part", "_before", "_here", *(f"_of_{c}" for c in by))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *by, *order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(*by, F.col(part).alias(here)).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*by).orderBy(here).rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], here, earlier.alias(before)).where(F.col(before) > 0)
    within = F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)) - 1
    numbered = ranged.withColumn(out, within)
    match = same_keys(numbered, begun, [(part, here), *zip(by, names, strict=True)])
    joined = numbered.join(F.broadcast(begun), match, "left")  # a row for each range
    return joined.withColumn(out, (F.col(out) + F.coalesce(before, F.lit(0))).cast("long")).drop(part, here, before, *names)


def over_last(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, make: Callable[[WindowSpec], Column], out: str) -> DataFrame:
    """``out``: what ``make`` says of a window of each signal in the order of columns that identify a row; it looks back ``n`` rows at most.

    A signal of more than ``LONGEST`` rows is cut into blocks; the last ``n`` rows
    of a block are copied to the next, so that windows stay within a block.
    """
    if not _is_long(df, by):
        return df.withColumn(out, make(Window.partitionBy(*by).orderBy(*order)))
    kept, (at, block, own) = [c for c in df.columns if c != out], fresh_names(df, "_at", "_block", "_own")
    size = max(LONGEST, n)
    home = F.floor(F.col(at) / size)
    both = F.when(F.col(at) % size >= size - n, F.array(home, home + 1)).otherwise(F.array(home)) if n else F.array(home)
    rows = _numbered(df, by, order, at)
    rows = rows.withColumn(block, F.explode(both)).withColumn(own, F.col(block) == home)
    return rows.withColumn(out, make(Window.partitionBy(*by, block).orderBy(at))).where(own).select(*kept, out)


def moving_rms(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int, out: str = "moving_rms", floor: float = 1e-8) -> DataFrame:
    """RMS over the last ``n`` samples, those before the first counting as zeros, plus a floor under the root."""
    x = F.coalesce(F.col(value), F.lit(0.0))
    return over_last(df, by, order, n - 1, lambda w: F.sqrt(F.sum(x * x).over(w.rowsBetween(-(n - 1), 0)) / n + floor), out)


def shifted(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int, out: str, default: float | None = 0.0) -> DataFrame:
    """The value ``n`` samples before, ``default`` where there is none."""
    return over_last(df, by, order, n, lambda w: F.lag(value, n, default).over(w), out)


def sample_index(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "i") -> DataFrame:
    """Samples numbered from 0 within their signal."""
    if _is_long(df, by):
        return _numbered(df, by, order, out)
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def segment_smooth(df: DataFrame, by: Sequence[str], index: str, value: str, length: int) -> DataFrame:
    """Means over half-overlapping raised-cosine segments centred at multiples of half a length.

    A sample belongs to the segments of the two centres around it, so it yields
    two weighted rows and no join is needed. Columns: keys, ``segment``, ``smooth``.
    """
    half = length // 2
    at = F.floor(F.col(index) / half)
    into = F.col(index) - at * half
    rising = F.lit(0.5) - F.cos(F.pi() * into / half) / 2
    sides = F.array(F.struct(at.alias("segment"), (1 - rising).alias("w")), F.struct((at + 1).alias("segment"), rising.alias("w")))
    rows = df.select(*by, F.col(value).alias("_x"), F.inline(sides))
    out = rows.groupBy(*by, "segment").agg(F.sum(F.col("w") * F.col("_x")).alias("_s"), F.sum("w").alias("_w"))
    return out.where("_w > 0").select(*by, F.col("segment").cast("long"), (F.col("_s") / F.col("_w")).alias("smooth"))


def gated_levels(df: DataFrame, by: Sequence[str], index: str, value: str, *, window: int, relative_db: float, share: float | None = None) -> DataFrame:
    """``gating.gated`` of signals in long form: keys, n, rms, threshold_db, relative_db and active.

    Samples are summed by window, windows are counted by level; a signal's
    threshold is sought in its histogram, and no task holds its windows. Null
    samples are 0. A window counts if none of its samples is missing.
    """
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    sums = df.groupBy(*by, F.floor(F.col(index) / window).alias("_w")).agg(F.count(F.lit(1)).alias("_n"), F.sum(x * x).alias("_e"))
    windows = checkpointed(sums)
    names = [f"_of_{c}" for c in by]

    def meet(rows: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
        other = one.withColumnsRenamed(dict(zip(by, names, strict=True)))
        return rows.join(other, same_keys(rows, other, list(zip(by, names, strict=True))), how).drop(*names)

    signals = windows.groupBy(*by).agg(F.sum("_n").alias("n"), gating.first_threshold(F.sum("_e") / F.sum("_n"), relative_db).alias("_t"))
    whole = meet(windows.where(F.col("_n") == window).drop("_n"), signals.select(*by, "_t"))
    loud = whole.select(*by, "_e", "_t", gating.window_db(F.col("_e") / window, F.col("_t")).alias("_db"))
    if share is not None:
        ends = loud.groupBy(*by).agg(F.min("_db").alias("_low"), F.max("_db").alias("_high"), F.floor(F.lit(100 - share) * F.count(F.lit(1)) / 100).alias("_out"))
        placed = meet(loud, ends).withColumn("_bin", gating.bin_of(F.col("_db"), F.col("_low"), F.col("_high")))
        upto = F.sum("_m").over(Window.partitionBy(*by).orderBy("_bin"))
        counts = placed.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_m"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.first("_out").alias("_out")).withColumn("_upto", upto)
        reached = counts.where((F.col("_upto") > F.col("_out")) | (F.col("_bin") == gating.BINS - 1)).groupBy(*by).agg(F.min("_bin").alias("_bin"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
        at = reached.select(*by, gating.share_threshold(F.col("_low"), F.col("_high"), F.col("_bin")).alias("_at"))
        loud = meet(loud, at).drop("_t").withColumnRenamed("_at", "_t")
    found = loud.groupBy(*by).agg(F.first("_t").alias("threshold_db"), F.count(F.when(F.col("_db") >= F.col("_t"), 1)).alias("_k"), F.sum(F.when(F.col("_db") >= F.col("_t"), F.col("_e"))).alias("_s"))
    joined = meet(signals, found, "left")  # a signal without a whole window has a row too
    rms = F.when(F.col("_k") > 0, F.sqrt(F.col("_s") / (F.col("_k") * window)))
    threshold = F.coalesce("threshold_db", "_t")
    return joined.select(*by, "n", rms.alias("rms"), threshold.alias("threshold_db"), (threshold - 20 * F.log10(rms)).alias("relative_db"), (F.lit(100.0) * window * F.coalesce("_k", F.lit(0)) / F.col("n")).alias("active"))


def voiced_frames(df: DataFrame, key: str, signal: str, *, window: int, hop: int, range_db: float) -> DataFrame:
    """Frames of each signal with their energy in dB, and whether it lies within ``range_db`` of the signal's loudest frame.

    Frames stay in their row; the loudest is an array maximum, not a shuffle.
    """
    cut = F.transform(frames(F.col(signal), window, hop, last=True), lambda f: 10 * F.log10(energy(f) + 1e-12))
    rows = df.select(key, cut.alias("_db")).withColumn("_top", F.array_max("_db"))
    return rows.select(key, "_top", F.posexplode("_db").alias("frame", "energy_db")).withColumn("voiced", F.col("energy_db") > F.col("_top") - range_db).drop("_top")


def overlap_add(df: DataFrame, by: Sequence[str], frame: str, samples: str, hop: int) -> DataFrame:
    """Frames summed back into samples. Columns: keys, ``i``, ``x``."""
    rows = df.select(*by, frame, F.posexplode(samples).alias("_j", "_x"))
    return rows.groupBy(*by, (F.col(frame) * hop + F.col("_j")).cast("long").alias("i")).agg(F.sum("_x").alias("x"))
