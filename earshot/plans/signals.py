"""Queries over signals: vectors of ``embeddings`` as short signals, values of ``events`` as long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import arrays as A
from earshot.functions import gating, segments
from earshot.functions.audiogram import CAMFIT_BANDS, FREQUENCIES, NALR_FREQUENCIES, audiogram, camfit_gains, camfit_intercepts, limited_gains, nalr_gains, resampled
from earshot.kernels.dynamics import compressed
from earshot.kernels.prescription import amplified
from earshot.operators import framing
from earshot.plans.common import q6, r6, table

_E = "list_transform(embedding, lambda x: x::DOUBLE)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("x"))


def array_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _signals(spark, sf_dir).select("vec_id", r6(A.rms(x)).alias("rms"), r6(A.level_db(x)).alias("level_db"), r6(A.mean(x)).alias("mean"))


ARRAY_RMS = f"""WITH s AS (SELECT vec_id, {_E} AS e FROM embeddings), t AS (SELECT vec_id, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) AS r, list_avg(e) AS m FROM s)
SELECT vec_id, {q6("r")} AS rms, {q6("CASE WHEN r > 0 THEN 20 * log10(r) END")} AS level_db, {q6("m")} AS mean FROM t"""


def clip_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = F.transform("x", lambda v: v * 8)
    return _signals(spark, sf_dir).select("vec_id", A.clip_count(loud).alias("clipped"), A.clip_count(A.hard_clip(loud)).alias("after"))


CLIP_COUNT = f"SELECT vec_id, CAST(len(list_filter({_E}, lambda x: abs(x * 8) > 1)) AS INTEGER) AS clipped, CAST(0 AS INTEGER) AS after FROM embeddings"


def soft_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", r6(A.total(A.soft_clip(F.transform("x", lambda v: v * 8)))).alias("clipped_sum"))


SOFT_CLIP = f"SELECT vec_id, {q6(f'list_sum(list_transform({_E}, lambda x: (exp(16 * x) - 1) / (exp(16 * x) + 1)))')} AS clipped_sum FROM embeddings"


def pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = A.to_pcm16(F.transform("x", lambda v: v * 4))
    return _signals(spark, sf_dir).select("vec_id", F.array_join(F.transform(samples, lambda v: v.cast("string")), ",").alias("pcm"))


PCM16 = f"SELECT vec_id, array_to_string(list_transform({_E}, lambda x: CAST(trunc(greatest(least(x * 4 * 32768, 32767.0), -32768.0)) AS INTEGER)), ',') AS pcm FROM embeddings"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal with the one before it of its label."""
    return framing.shifted(_signals(spark, sf_dir), ["label"], ["vec_id"], "x", 1, "y", default=None).select("vec_id", "x", "y").where("y is not null")


_PAIRS = f"WITH p AS (SELECT vec_id, {_E} AS x, lag({_E}) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings)"


def si_snr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", r6(A.si_snr(F.col("x"), F.col("y"))).alias("si_snr"))


SI_SNR = f"""{_PAIRS}, c AS (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS e, list_transform(y, lambda v: v - list_avg(y)) AS t FROM p WHERE y IS NOT NULL),
k AS (SELECT vec_id, e, t, list_dot_product(t, t) AS tt, list_dot_product(e, t) / (list_dot_product(t, t) + 1e-8) AS a FROM c),
n AS (SELECT vec_id, a * a * tt AS s, list_sum(list_transform(range(1, len(e) + 1), lambda i: pow(e[i] - t[i] * a, 2))) AS z FROM k)
SELECT vec_id, {q6("20 * log10(1e-8 + sqrt(s) / (sqrt(z) + 1e-8))")} AS si_snr FROM n"""


def snr_loss_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", r6(A.snr_loss(F.col("x"), F.col("y"))).alias("snr_loss"))


SNR_LOSS = f"""{_PAIRS}, e AS (SELECT vec_id, list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(y[i] - x[i], 2))) AS d, list_dot_product(y, y) AS t FROM p WHERE y IS NOT NULL)
SELECT vec_id, {q6("10 * log10(d + 1e-3 * t + 1e-8) - 10 * log10(t + 1e-8)")} AS snr_loss FROM e"""


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", r6(A.cosine(F.col("x"), F.col("y"))).alias("cosine"))


COSINE = f"{_PAIRS} SELECT vec_id, {q6('list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y))')} AS cosine FROM p WHERE y IS NOT NULL"


def snr_scale_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal with the one before it as noise, 6 dB below."""
    mixed = A.mixed_at_snr(F.col("x"), F.col("y"), F.lit(6.0))
    return _pairs(spark, sf_dir).select("vec_id", r6(A.snr_db(F.col("x"), F.col("y"))).alias("snr"), r6(A.rms(mixed)).alias("mixed_rms"))


SNR_MIX = f"""{_PAIRS}, l AS (SELECT vec_id, x, y, 10 * log10(list_dot_product(x, x) / list_dot_product(y, y)) AS snr FROM p WHERE y IS NOT NULL)
SELECT vec_id, {q6("snr")} AS snr, {q6("sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(x[i] + y[i] * pow(10, (snr - 6) / 20), 2))) / len(x))")} AS mixed_rms FROM l"""


def stem_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of all signals of a label, sample by sample: partial sums per task, not whole signals, are moved."""
    rows = _signals(spark, sf_dir).select("label", F.posexplode("x").alias("i", "x"))
    return rows.groupBy("label", "i").agg(r6(F.sum("x")).alias("x"))


STEM_MIX = f"SELECT label, CAST(i AS INTEGER) AS i, {q6('sum(x)')} AS x FROM (SELECT label, unnest({_E}) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i"


def stem_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of -6 to 3 dB by label, then the level."""
    gained = A.scaled(F.col("x"), A.db_to_gain(F.pmod("label", F.lit(10)) - F.lit(6.0)))
    return _signals(spark, sf_dir).select("vec_id", r6(A.rms(gained)).alias("rms"), r6(F.element_at(gained, 1)).alias("first"))


STEM_GAIN = f"""WITH g AS (SELECT vec_id, list_transform({_E}, lambda x: x * pow(10, (((label % 10) + 10) % 10 - 6.0) / 20)) AS e FROM embeddings)
SELECT vec_id, {q6("sqrt(list_dot_product(e, e) / len(e))")} AS rms, {q6("e[1]")} AS first FROM g"""


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = A.standardised(F.col("x"))
    return _signals(spark, sf_dir).select("vec_id", r6(F.element_at(z, 1)).alias("first"), r6(A.rms(z)).alias("rms"))


STANDARDISED = f"""WITH s AS (SELECT vec_id, {_E} AS e FROM embeddings), m AS (SELECT vec_id, e, list_avg(e) AS m, list_stddev_pop(e) AS d FROM s)
SELECT vec_id, {q6("(e[1] - m) / d")} AS first, {q6("sqrt(list_sum(list_transform(e, lambda x: pow((x - m) / d, 2))) / len(e))")} AS rms FROM m"""


def peak_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _signals(spark, sf_dir).select("vec_id", A.first_argmax(x).cast("int").alias("at"), r6(A.rms(A.peak_normalised(x))).alias("rms"))


PEAK = f"""WITH s AS (SELECT vec_id, {_E} AS e FROM embeddings), m AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS p FROM s)
SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS at, {q6("sqrt(list_dot_product(e, e) / len(e)) / p")} AS rms FROM m"""


def audiogram_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of each vector's audiogram at frequencies between and beyond its own."""
    levels = F.transform(F.slice("x", 1, 8), lambda v: F.abs(v) * 200)
    gram = resampled(audiogram(levels), (125, 750, 1500, 5000, 12000))
    rows = _signals(spark, sf_dir).select("vec_id", gram.alias("g")).withColumn("l", F.col("g.levels"))
    return rows.select("vec_id", *[r6(F.element_at("l", i + 1)).alias(f"hz_{f}") for i, f in enumerate((125, 750, 1500, 5000, 12000))])


def _between(i: int, f: float) -> str:
    f0, f1 = FREQUENCIES[i - 1], FREQUENCIES[i]
    return q6(f"l[{i}] + (l[{i + 1}] - l[{i}]) * (ln({f}) - ln({f0})) / (ln({f1}) - ln({f0}))")


RESAMPLE = f"""WITH g AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: abs(x::DOUBLE) * 200) AS l FROM embeddings)
SELECT vec_id, {q6("l[1]")} AS hz_125, {_between(2, 750)} AS hz_750, {_between(3, 1500)} AS hz_1500, {_between(6, 5000)} AS hz_5000, {q6("l[8]")} AS hz_12000 FROM g"""


def nalr_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.transform(F.slice("x", 1, 6), lambda v: F.abs(v) * 400)
    rows = _signals(spark, sf_dir).select("vec_id", nalr_gains(levels).alias("g"))
    return rows.select("vec_id", *[r6(F.element_at("g", i + 1)).alias(f"gain_{f}") for i, f in enumerate(NALR_FREQUENCIES)])


_NALR = ", ".join(f"{q6(f'CASE WHEN list_max(l) > 0 THEN greatest(b + 0.31 * l[{i + 1}] + ({bias}), 0.0) ELSE 0.0 END')} AS gain_{f}" for i, (f, bias) in enumerate(zip(NALR_FREQUENCIES, (-17, -8, 1, -1, -2, -2), strict=True)))
NALR = f"""WITH g AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: abs(x::DOUBLE) * 400) AS l FROM embeddings),
h AS (SELECT vec_id, l, CASE WHEN l[2] + l[3] + l[4] <= 180 THEN 0.05 * (l[2] + l[3] + l[4]) ELSE 9 + 0.116 * (l[2] + l[3] + l[4] - 180) END AS b FROM g)
SELECT vec_id, {_NALR} FROM h"""


def camfit_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain table: a row for each vector's audiogram, band and input level."""
    levels = F.transform(F.slice("x", 1, 8), lambda v: F.abs(v) * 200)
    rows = _signals(spark, sf_dir).select("vec_id", camfit_gains(audiogram(levels)).alias("g"))
    inputs = F.explode(F.array(*[F.lit(float(v)) for v in (45, 65, 85)])).alias("level")
    rows = rows.select("vec_id", "g", inputs).select("vec_id", "level", F.posexplode(limited_gains(F.col("g"), F.col("level"))).alias("band", "gain"))
    return rows.select("vec_id", "level", "band", r6(F.col("gain")).alias("gain"))


def _camfit_level(f: float) -> str:
    above = next((i for i, v in enumerate(FREQUENCIES) if v > f), len(FREQUENCIES))
    if above in (0, len(FREQUENCIES)):
        return f"l[{max(1, above)}]"
    f0, f1 = FREQUENCIES[above - 1], FREQUENCIES[above]
    return f"(l[{above}] + (l[{above + 1}] - l[{above}]) * (ln({f}) - ln({f0})) / (ln({f1}) - ln({f0})))"


CAMFIT = f"""WITH g AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: abs(x::DOUBLE) * 200) AS l FROM embeddings),
h AS (SELECT vec_id, [{", ".join(_camfit_level(f) for f in CAMFIT_BANDS)}] AS h FROM g),
e AS (SELECT vec_id, h, unnest([45.0, 65.0, 85.0])::DOUBLE AS level FROM h), b AS (SELECT vec_id, h, level, unnest(range(0, 9)) AS i FROM e)
SELECT vec_id, level, CAST(i AS INTEGER) AS band, {q6(f"CASE WHEN len(list_filter(h, lambda v: v <> 0)) > 0 THEN least(greatest(h[i + 1] * 0.48 + {camfit_intercepts()}[i + 1], 0.0), 100 - level) ELSE 0.0 END")} AS gain FROM b"""


def frame_energy_vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.voiced_frames(_signals(spark, sf_dir), "vec_id", "x", window=16, hop=8, range_db=6.0)
    return out.select("vec_id", "frame", r6(F.col("energy_db")).alias("energy_db"), "voiced")


VAD = f"""WITH s AS (SELECT vec_id, {_E} AS e FROM embeddings), f AS (SELECT vec_id, unnest(range(0, len(e) - 16 + 1, 8)) AS i, e FROM s),
d AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS frame, 10 * log10(list_sum(list_transform(e[i + 1:i + 16], lambda x: x * x)) + 1e-12) AS db FROM f)
SELECT vec_id, frame, {q6("db")} AS energy_db, db > max(db) OVER (PARTITION BY vec_id) - 6.0 AS voiced FROM d"""


def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of half overlap, summed back by label."""
    rows = _signals(spark, sf_dir).select("label", F.posexplode(A.frames(F.col("x"), 16, 8, last=True)).alias("frame", "samples"))
    return framing.overlap_add(rows, ["label"], "frame", "samples", 8).select("label", "i", r6(F.col("x")).alias("x"))


OVERLAP = f"""WITH s AS (SELECT label, {_E} AS e FROM embeddings), f AS (SELECT label, unnest(range(0, len(e) - 16 + 1, 8)) AS a, e FROM s),
j AS (SELECT label, a, e, unnest(range(0, 16)) AS j FROM f)
SELECT label, CAST(a + j AS BIGINT) AS i, {q6("sum(e[a + j + 1])")} AS x FROM j GROUP BY 1, 2"""


def moving_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.moving_rms(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 7)
    return out.select("event_id", r6(F.col("moving_rms")).alias("moving_rms"))


MOVING = f"SELECT event_id, {q6('sqrt(sum(coalesce(value, 0) * coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING) / 7 + 1e-8)')} AS moving_rms FROM events"


def group_delay_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.shifted(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value", 3, "delayed")
    return out.select("event_id", r6(F.col("delayed")).alias("delayed"), r6(F.col("value") - F.col("delayed")).alias("difference"))


SHIFT = f"WITH l AS (SELECT event_id, value, lag(value, 3, 0.0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d FROM events) SELECT event_id, {q6('d')} AS delayed, {q6('value - d')} AS difference FROM l"


def segment_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framing.sample_index(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return framing.segment_smooth(rows, ["user_id"], "i", "value", 8).select("user_id", "segment", r6(F.col("smooth")).alias("smooth"))


SEGMENT = f"""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
s AS (SELECT user_id, value, i // 4 AS segment, 1 - (0.5 - cos(pi() * (i % 4) / 4) / 2) AS w FROM e
  UNION ALL SELECT user_id, value, i // 4 + 1, 0.5 - cos(pi() * (i % 4) / 4) / 2 FROM e)
SELECT user_id, CAST(segment AS BIGINT) AS segment, {q6("sum(w * value) / sum(w)")} AS smooth FROM s GROUP BY user_id, segment HAVING sum(w) > 0"""


def gated_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each event type's values over the windows of ten that reach 1 dB above the whole, threshold and share of active samples."""
    rows = framing.sample_index(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"])
    out = framing.gated_levels(rows, ["event_type"], "i", "value", window=10, relative_db=1.0)
    return out.select("event_type", "n", *[r6(F.col(c)).alias(c) for c in ("rms", "threshold_db", "relative_db", "active")])


_GATED_WINDOWS = """e AS (SELECT event_type, coalesce(value, 0.0) AS x, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 10 AS w FROM events),
s AS (SELECT event_type, count(*) AS n, greatest(20 * log10(sqrt(avg(x * x))) + {}, -80.0) AS t FROM e GROUP BY event_type),
w AS (SELECT event_type, w, sum(x * x) AS e FROM e GROUP BY event_type, w HAVING count(*) = 10),
d AS (SELECT event_type, n, t, e, 10 * log10(pow(10.0, (t - 30.0) / 10) + e / 10) AS db FROM w JOIN s USING (event_type))"""
_GATED_OUT = f"""SELECT event_type, n, {q6("l")} AS rms, {q6("t")} AS threshold_db, {q6("t - 20 * log10(l)")} AS relative_db, {q6("1000.0 * k / n")} AS active
FROM (SELECT event_type, any_value(n) AS n, any_value(t) AS t, count(*) FILTER (db >= t) AS k, sqrt(sum(e) FILTER (db >= t) / (10 * count(*) FILTER (db >= t))) AS l FROM d GROUP BY event_type)"""
GATED = f"WITH {_GATED_WINDOWS.format('1.0')} {_GATED_OUT}"


def share_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over about the loudest fifth of the windows, by a histogram of their levels."""
    rows = framing.sample_index(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"])
    out = framing.gated_levels(rows, ["event_type"], "i", "value", window=10, relative_db=-12.0, share=20)
    return out.select("event_type", "n", *[r6(F.col(c)).alias(c) for c in ("rms", "threshold_db", "relative_db", "active")])


SHARE = f"""WITH {_GATED_WINDOWS.format("(-12.0)")}, r AS (SELECT event_type, min(db) AS low, max(db) AS high, list(db ORDER BY db)[CAST(floor(80 * count(*) / 100) AS INTEGER) + 1] AS v FROM d GROUP BY event_type),
b AS (SELECT event_type, low, high, v, len(list_filter(range(1, 140), lambda i: v >= low + i * ((high - low) / 140))) AS bin FROM r),
f AS (SELECT d.event_type, n, e, db, low + greatest(bin, 1) * ((high - low) / 140) AS t FROM d JOIN b USING (event_type)) {_GATED_OUT.replace("FROM d GROUP", "FROM f GROUP")}"""


def gated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud windows of each vector as a signal: those above its level, and about half of all."""
    g, h = A.let(A.doubles(F.col("embedding")), lambda x: gating.gated(x, 4, 0.0)), A.let(A.doubles(F.col("embedding")), lambda x: gating.gated(x, 4, -12.0, share=50))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", g.alias("g"), h.alias("h"))
    joined = lambda c: F.array_join(F.transform(f"{c}.windows", lambda i: i.cast("string")), ",")
    return rows.select("vec_id", r6(F.col("g.rms")).alias("rms"), joined("g").alias("windows"), r6(F.col("h.rms")).alias("half_rms"), r6(F.col("h.threshold_db")).alias("half_db"), joined("h").alias("half_windows"))


def _loud_sql(name: str, relative: float) -> str:
    return f"""{name} AS (SELECT vec_id, e, greatest(20 * log10(sqrt(list_dot_product(x, x) / len(x))) + ({relative}), -80.0) AS t,
  list_transform(e, lambda v: 10 * log10(pow(10.0, (greatest(20 * log10(sqrt(list_dot_product(x, x) / len(x))) + ({relative}), -80.0) - 30.0) / 10) + v)) AS db FROM w)"""


GATED_SIGNALS = f"""WITH s AS (SELECT vec_id, {_E} AS x FROM embeddings),
w AS (SELECT vec_id, x, list_transform(range(0, len(x) // 4), lambda i: list_dot_product(x[4 * i + 1:4 * i + 4], x[4 * i + 1:4 * i + 4]) / 4) AS e FROM s),
{_loud_sql("a", 0.0)}, {_loud_sql("b", -12.0)},
c AS (SELECT vec_id, e, db, list_min(db) AS low, list_max(db) AS high, list_sort(db)[CAST(floor(50 * len(db) / 100) AS INTEGER) + 1] AS v FROM b),
h AS (SELECT vec_id, e, db, low + greatest(len(list_filter(range(1, 140), lambda i: v >= low + i * ((high - low) / 140))), 1) * ((high - low) / 140) AS t FROM c),
k AS (SELECT a.vec_id, a.e, h.t, list_filter(range(0, len(a.db)), lambda i: a.db[i + 1] >= a.t) AS g, list_filter(range(0, len(h.db)), lambda i: h.db[i + 1] >= h.t) AS h FROM a JOIN h USING (vec_id))
SELECT vec_id, {q6("sqrt(list_sum(list_transform(g, lambda i: e[i + 1])) / len(g))")} AS rms, array_to_string(g, ',') AS windows,
{q6("sqrt(list_sum(list_transform(h, lambda i: e[i + 1])) / len(h))")} AS half_rms, {q6("t")} AS half_db, array_to_string(h, ',') AS half_windows FROM k"""


def segment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of each signal and the one before it of its label over windows of thirty frames, frames of the loudest two thirds or so active."""
    rows = _pairs(spark, sf_dir).select("vec_id", F.transform("x", F.abs).alias("x"), F.transform("y", F.abs).alias("y"))
    active = F.transform("x", lambda v: (v > 0.05).cast("int"))
    return rows.select("vec_id", r6(segments.segment_match(F.col("x"), F.col("y"), 30, active=active)).alias("active_match"), r6(segments.segment_match(F.col("x"), F.col("y"), 30)).alias("match"))


def _match_sql(mask: str) -> str:
    return f"""(SELECT sum(c) / (sum(m) / 30 + 1e-8) FROM (
  SELECT list_sum(list_transform(range(1, 31), lambda t: (a[t] - ma) * (b[t] - mb) * w[t])) / ((sqrt(list_sum(list_transform(range(1, 31), lambda t: pow((a[t] - ma) * w[t], 2)))) + 1e-8) * (sqrt(list_sum(list_transform(range(1, 31), lambda t: pow((b[t] - mb) * w[t], 2)))) + 1e-8)) AS c, list_sum(w) AS m
  FROM (SELECT *, list_dot_product(a, w) / (list_sum(w) + 1e-8) AS ma, list_dot_product(b, w) / (list_sum(w) + 1e-8) AS mb
    FROM (SELECT a, w, list_transform(range(1, 31), lambda t: least(b[t] * g, a[t] * (1 + pow(10, 15.0 / 20)))) AS b
      FROM (SELECT *, sqrt(list_sum(list_transform(range(1, 31), lambda t: pow(a[t] * w[t], 2)))) / (sqrt(list_sum(list_transform(range(1, 31), lambda t: pow(b[t] * w[t], 2)))) + 1e-8) AS g
        FROM (SELECT x[i:i + 29] AS a, y[i:i + 29] AS b, list_transform(x[i:i + 29], lambda v: {mask}) AS w FROM (SELECT unnest(range(1, len(x) - 28)) AS i)))))))"""


MATCH = f"""{_PAIRS}, e AS (SELECT vec_id, list_transform(x, lambda v: abs(v)) AS x, list_transform(y, lambda v: abs(v)) AS y FROM p WHERE y IS NOT NULL)
SELECT vec_id, {q6(_match_sql("CASE WHEN v > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))} AS active_match, {q6(_match_sql("1.0::DOUBLE"))} AS match FROM e"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each event type in five-minute windows."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return rows.select(F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("start_s"), "event_type", "n", r6(F.col("rms")).alias("rms"))


WINDOWS = f"SELECT CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, {q6('sqrt(avg(value * value))')} AS rms FROM events GROUP BY 1, 2"

def compressor_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signals through the compressor."""
    rows = _signals(spark, sf_dir).select("vec_id", A.scaled(F.col("x"), F.lit(4.0)).alias("x"))
    out = compressed(rows, rate=1000, attack=5, release=20, threshold=0.35, attenuation=0.1)
    return out.select("vec_id", r6(A.rms(F.col("compressed"))).alias("rms"), r6(F.col("gain")).alias("gain"))


#: The recurrence sample by sample; all signals are shorter than the window of 200 samples.
COMPRESSOR = f"""WITH RECURSIVE g AS (
  SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 4) AS x, 0 AS i, 0.0::DOUBLE AS e, 1.0::DOUBLE AS c, 0.0::DOUBLE AS z FROM embeddings
  UNION ALL
  SELECT vec_id, x, i + 1, e2, c2, z + pow(x[i + 1] * c2, 2) FROM (
    SELECT *, CASE WHEN r > 0.35 THEN c * 0.8 + (r * 0.1 + 0.9 * 0.35) * 0.2 ELSE 0.05 + c * 0.95 END AS c2 FROM (
      SELECT *, sqrt(e2 / 200 + 1e-8) AS r FROM (SELECT *, e + x[i + 1] * x[i + 1] AS e2 FROM g WHERE i < len(x)))))
SELECT vec_id, {q6("sqrt(z / len(x))")} AS rms, {q6("c")} AS gain FROM g WHERE i = len(x)"""


def hearing_aid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAL-R fit, filter, then compressor and full scale, as a baseline hearing aid does it."""
    levels = F.transform(F.slice("x", 1, 6), lambda v: F.abs(v) * 400)
    rows = _signals(spark, sf_dir).select("vec_id", "x", nalr_gains(levels).alias("gains"))
    out = compressed(amplified(rows, rate=16000), rate=16000, signal_col="amplified")
    return out.select("vec_id", r6(A.rms(F.col("amplified"))).alias("amplified_rms"), A.clip_count(F.col("compressed")).alias("clipped"), r6(A.rms(A.soft_clip(F.col("compressed")))).alias("rms"))


QUERIES = {
    f.__name__: f
    for f in (array_rms, clip_count, soft_clip, pcm16, si_snr_pairs, snr_loss_pairs, cosine_pairs, snr_scale_mix, stem_mix, stem_gain, standardised, peak_index, audiogram_resample, nalr_gain, camfit_gain)
    + (frame_energy_vad, overlap_add, moving_rms, group_delay_shift, segment_smooth, gated_level, share_level, gated_signals, segment_match, event_windows, compressor_gain, hearing_aid)
}
SQL = {
    "array_rms": ARRAY_RMS,
    "clip_count": CLIP_COUNT,
    "soft_clip": SOFT_CLIP,
    "pcm16": PCM16,
    "si_snr_pairs": SI_SNR,
    "snr_loss_pairs": SNR_LOSS,
    "compressor_gain": COMPRESSOR,
    "cosine_pairs": COSINE,
    "snr_scale_mix": SNR_MIX,
    "stem_mix": STEM_MIX,
    "stem_gain": STEM_GAIN,
    "standardised": STANDARDISED,
    "peak_index": PEAK,
    "audiogram_resample": RESAMPLE,
    "nalr_gain": NALR,
    "camfit_gain": CAMFIT,
    "frame_energy_vad": VAD,
    "overlap_add": OVERLAP,
    "moving_rms": MOVING,
    "group_delay_shift": SHIFT,
    "segment_smooth": SEGMENT,
    "gated_level": GATED,
    "share_level": SHARE,
    "gated_signals": GATED_SIGNALS,
    "segment_match": MATCH,
    "event_windows": WINDOWS,
}
