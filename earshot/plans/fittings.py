"""Queries of hearing-aid fittings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import arrays as A
from earshot.functions import fitting
from earshot.functions.audiogram import CAMFIT_BANDS, audiogram, camfit_intercepts
from earshot.plans.common import q6, r6, table
from earshot.plans.signals import _camfit_level

LEVELS, GATE, SLOPE, SPOKEN = tuple(range(-10, 111, 5)), 47.0, 2.0, 65


def gain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's audiogram fitted: by band the sum of the gated compressive gains over all input levels, and the gain for 65 dB."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice(A.doubles(F.col("embedding")), 1, 8), lambda v: F.abs(v) * 200).alias("l"))
    gains = fitting.gated_gains(fitting.compressive_gains(audiogram(F.col("l")), LEVELS), LEVELS, gate=GATE, slope=SLOPE)
    rows = rows.select("vec_id", F.posexplode(gains).alias("band", "g"))
    return rows.select("vec_id", "band", r6(A.total(F.col("g"))).alias("total"), r6(F.get("g", F.lit(LEVELS.index(SPOKEN)))).alias("at_65"))


def _values(*columns: tuple) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(f'{float(v)!r}::DOUBLE' for v in row)})" for row in zip(*columns, strict=True)) + ")"


_I = range(len(CAMFIT_BANDS))
GAIN_TABLE = f"""WITH t AS (SELECT * FROM {_values(fitting.SPEECH_HZ, fitting.SPEECH_DB)} AS t(f, db)),
e AS (SELECT db, coalesce(sqrt(f * lag(f) OVER (ORDER BY f)), 0) AS lo, coalesce(sqrt(f * lead(f) OVER (ORDER BY f)), f * pow(2, 1 / 6::DOUBLE)) AS hi FROM t),
b AS (SELECT * FROM {_values(_I, CAMFIT_BANDS, fitting.CAMFIT_EDGES[:-1], fitting.CAMFIT_EDGES[1:])} AS b(i, f, a, z)),
s AS (SELECT i, 10 * log10(sum(pow(10, db / 10) * greatest(least(z, hi) - greatest(a, lo), 0) / (hi - lo))) - 43 AS faint FROM b, e GROUP BY i),
c AS (SELECT f, db, lead(f) OVER (ORDER BY f) AS f1, lead(db) OVER (ORDER BY f) AS db1 FROM {_values(fitting.THRESHOLD_HZ, fitting.THRESHOLD_DB)} AS c(f, db)),
k AS (SELECT CAST(i AS INTEGER) AS i, faint, db + (db1 - db) * (b.f - c.f) / (f1 - c.f) AS spl FROM b JOIN s USING (i) JOIN c ON c.f <= b.f AND b.f < f1),
g AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: abs(x::DOUBLE) * 200) AS l FROM embeddings),
h AS (SELECT vec_id, l, [{", ".join(_camfit_level(f) for f in CAMFIT_BANDS)}] AS h FROM g),
n AS (SELECT vec_id, i, faint, len(list_filter(l, lambda v: v <> 0)) > 0 AS loss, h[i + 1] + spl - faint AS needed,
  CASE WHEN len(list_filter(h, lambda v: v <> 0)) > 0 THEN greatest(h[i + 1] * 0.48 + {camfit_intercepts()}[i + 1], 0.0) ELSE 0.0 END AS linear FROM h, k),
r AS (SELECT *, greatest(38 / greatest(linear + 38 - needed, 13), 1) AS ratio FROM n),
x AS (SELECT vec_id, i, level, CASE WHEN loss THEN least(greatest((level - faint) / ratio + faint + needed - level, 0), 100 - level) ELSE 0 END AS gain FROM r, (SELECT unnest(range(-10, 111, 5))::DOUBLE AS level)),
y AS (SELECT *, max(CASE WHEN level = 45 THEN gain END) OVER w * 0.6::DOUBLE + max(CASE WHEN level = 50 THEN gain END) OVER w * 0.4::DOUBLE AS door FROM x WINDOW w AS (PARTITION BY vec_id, i))
SELECT vec_id, i AS band, {q6("sum(CASE WHEN level < 47 THEN (level - 47) * 2 + door ELSE gain END)")} AS total, {q6("max(CASE WHEN level = 65 THEN gain END)")} AS at_65 FROM y GROUP BY vec_id, i"""

QUERIES = {"gain_table": gain_table}
SQL = {"gain_table": GAIN_TABLE}
