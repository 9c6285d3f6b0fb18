"""Queries of score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.audiogram import FREQUENCIES, audiogram, severity
from earshot.functions.arrays import doubles
from earshot.operators import fits, stats
from earshot.plans.common import q6, r6, table

SCORES = ("rmse", "mae", "std_error", "ncc")


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 100).alias("predicted"))
    return stats.score_set(rows, "l_quantity", "predicted", ["l_returnflag"]).select("l_returnflag", "n", *[r6(F.col(c)).alias(c) for c in SCORES])


_XY = "l_quantity", "l_discount * 100"


def _score_sql(x: str, y: str) -> str:
    return f"""count(*) AS n, {q6(f"sqrt(avg(pow({x} - {y}, 2)))")} AS rmse, {q6(f"avg(abs({x} - {y}))")} AS mae,
      {q6(f"stddev_pop({x} - {y}) / sqrt(count(*))")} AS std_error,
      {q6(f"CASE WHEN count(*) > 1 AND stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")} AS ncc"""


SCORE_SUMMARY = f"SELECT l_returnflag, {_score_sql(*_XY)} FROM lineitem GROUP BY l_returnflag"


def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for each flag and status and over all, groups of two rows or more."""
    rows = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    out = rows.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), stats.rmse(x, y).alias("rmse"), stats.mae(x, y).alias("mae"))
    return out.where("n >= 2").select("l_returnflag", "l_linestatus", "n", r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"))


SCORE_ROLLUP = f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {q6("sqrt(avg(pow(l_quantity - l_discount * 100, 2)))")} AS rmse, {q6("avg(abs(l_quantity - l_discount * 100))")} AS mae
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) >= 2"""


def kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return stats.kendall_tau_b(rows, "n_chars", "quality").select("n", r6(F.col("tau_b")).alias("tau_b"))


KENDALL = f"""WITH p AS (SELECT row_number() OVER () AS i, n_chars AS x, quality AS y FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
s AS (SELECT CAST(sum(sign(a.x - b.x) * sign(a.y - b.y)) AS DOUBLE) AS s, CAST(sum(abs(sign(a.x - b.x))) AS DOUBLE) AS nx, CAST(sum(abs(sign(a.y - b.y))) AS DOUBLE) AS ny FROM p a JOIN p b ON a.i < b.i)
SELECT (SELECT count(*) FROM p) AS n, {q6("CASE WHEN nx * ny > 0 THEN s / sqrt(nx * ny) END")} AS tau_b FROM s"""


def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", "n", r6(F.col("spearman")).alias("spearman"))


SPEARMAN = f"""WITH r AS (SELECT p_brand,
  rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS ry
  FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL)
SELECT p_brand, count(*) AS n, {q6("CASE WHEN count(*) > 1 AND stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END")} AS spearman FROM r GROUP BY p_brand"""


def band_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount and tax by bands of the quantity, moved to -12 to 6 as signal-to-noise ratios are."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 0.4 - 13).alias("snr"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    out = stats.band_report(rows, "snr", ["discount", "tax"], low=-12.0, width=3.0, bins=6)
    return out.select("band", "above", "upto", "n", r6(F.col("mean_discount")).alias("mean_discount"), r6(F.col("mean_tax")).alias("mean_tax"))


BAND = f"""WITH b AS (SELECT CAST(ceil((l_quantity * 0.4 - 13 + 12.0) / 3.0) - 1 AS INTEGER) AS band, l_discount AS d, l_tax AS t FROM lineitem)
SELECT CAST(e.band AS INTEGER) AS band, -12.0::DOUBLE + e.band * 3.0::DOUBLE AS above, -12.0::DOUBLE + (e.band + 1) * 3.0::DOUBLE AS upto, count(b.band) AS n, {q6("avg(d)")} AS mean_discount, {q6("avg(t)")} AS mean_tax
FROM range(6) AS e(band) LEFT JOIN b ON b.band = e.band GROUP BY e.band"""


def _levels(x: str = "embedding"):
    """The first eight components as hearing levels in dB."""
    return F.transform(F.slice(doubles(F.col(x)), 1, 8), lambda v: F.abs(v) * 200)


def severity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", severity(audiogram(_levels())).alias("severity"))


SEVERITY_SQL = """WITH l AS (SELECT vec_id, list_avg(list_transform(embedding[4:8], lambda x: abs(x::DOUBLE) * 200)) AS m FROM embeddings)
SELECT vec_id, CASE WHEN m > 56 THEN 'SEVERE' WHEN m > 35 THEN 'MODERATE' WHEN m > 15 THEN 'MILD' ELSE 'NOTHING' END AS severity FROM l"""


def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of listeners by class of hearing loss: levels from vectors, scores from the events of as many users."""
    classes = severity_class(spark, sf_dir)
    scores = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id")).agg(F.avg("value").alias("predicted"), F.max("value").alias("measured"))
    joined = classes.join(scores, "vec_id").withColumn("measured", F.col("measured") / 10)
    out = stats.score_set(joined, "measured", "predicted", ["severity"]).where("n >= 2")
    return out.select("severity", "n", *[r6(F.col(c)).alias(c) for c in SCORES])


SEVERITY_REPORT = f"""WITH c AS ({SEVERITY_SQL}), s AS (SELECT user_id AS vec_id, avg(value) AS p, max(value) / 10 AS m FROM events GROUP BY user_id)
SELECT severity, {_score_sql("m", "p")} FROM c JOIN s USING (vec_id) GROUP BY severity HAVING count(*) >= 2"""


def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic map from price to quantity for each ship flag; least squares have no form in SQL."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 100_000).alias("x"), (F.col("l_quantity") * 2).alias("y"))
    return fits.logistic_by(rows, "x", "y", ["l_returnflag"]).select("l_returnflag", "n", r6(F.col("x0")).alias("x0"), r6(F.col("k")).alias("k"))


def disjoint_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line's quantity from its price, by a map fitted to the lines of other numbers, flags and months: as intelligibility is predicted from signals, systems and listeners not heard."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.month("l_shipdate").alias("month"), (F.col("l_extendedprice") / 100_000).alias("x"), (F.col("l_quantity") * 2).alias("y"))
    out = fits.disjoint_predictions(rows, "x", "y", ["l_linenumber", "l_returnflag", "month"])
    return out.select("l_orderkey", "l_linenumber", "n_train", r6(F.col("predicted")).alias("predicted"))


QUERIES = {f.__name__: f for f in (score_summary, score_rollup, kendall_tau_b, spearman_by_group, band_report, severity_class, severity_report, logistic_fit, disjoint_logistic)}
SQL = {"score_summary": SCORE_SUMMARY, "score_rollup": SCORE_ROLLUP, "kendall_tau_b": KENDALL, "spearman_by_group": SPEARMAN, "band_report": BAND, "severity_class": SEVERITY_SQL, "severity_report": SEVERITY_REPORT}
