"""Whole studies: scenes built, signals enhanced and scored, results reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import arrays as A
from earshot.functions.keys import md5_seed
from earshot.kernels import alignment, loudness, mbstoi, quality, stoi
from earshot.operators import scenes, stats, worklist
from earshot.plans.common import q6, r6, table
from earshot.plans.signals import _pairs, _signals

SEED = 21


def scene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each order, its draws keyed by the order."""
    made = scenes.build_scenes(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=SEED)
    first = F.element_at("interferers", 1)
    return made.select("o_orderkey", "snr", "n_interferers", F.size("interferers").alias("listed"), first["kind"].alias("first_kind"), first["time_start"].alias("first_start"))


def _draw(name: str) -> str:
    half = lambda at: f"('0x' || substr(md5('{SEED}:{name}:' || o_orderkey), {at}, 16))::UBIGINT::HUGEINT % 100000000"
    return f"(CAST((({half(1)}) * (18446744073709551616::HUGEINT % 100000000) + ({half(17)})) % 100000000 AS DOUBLE) / 1e8)"


SCENES = f"""SELECT o_orderkey, round(-12.0::DOUBLE + {_draw("snr")} * 18.0::DOUBLE, 4) AS snr, CAST(floor(1 + {_draw("n")} * 3.0::DOUBLE) AS INTEGER) AS n_interferers,
CAST(floor(1 + {_draw("n")} * 3.0::DOUBLE) AS INTEGER) AS listed, ['speech', 'nonspeech', 'music'][CAST(floor({_draw("kind0")} * 3) AS INTEGER) + 1] AS first_kind,
CAST(round_even({_draw("start0")} * 2.0::DOUBLE * 44100, 0) AS INTEGER) AS first_start FROM orders"""


def loudness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness of vectors as 64-sample signals at 160 Hz, by label, and after they are brought to -23 LUFS."""
    rows = loudness.with_loudness(_signals(spark, sf_dir), rate=160, left="x", right=None)
    level = loudness.to_loudness(F.col("x"), F.col("lufs"), F.lit(-23.0))
    return rows.withColumn("level", A.level_db(level)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("lufs")).alias("lufs"), r6(F.avg("level")).alias("level"))


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag and warping distance of each signal and the one before it of its label."""
    return alignment.compared(_pairs(spark, sf_dir), most=16).select("vec_id", "lag", r6(F.col("dtw")).alias("dtw"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with their listeners' results, scored by band of the scene's ratio: work list, strict lookup, report."""
    made = scenes.build_scenes(table(spark, sf_dir, "orders"), "o_orderkey", seed=SEED).select(F.col("o_orderkey").alias("l_orderkey"), "snr")
    results = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("left"), F.col("l_tax").alias("right"))
    scored = worklist.lookup(results, made, ["l_orderkey"]).withColumn("better", F.greatest("left", "right"))
    out = stats.band_report(scored, "snr", ["better", "left"], low=-12.0, width=3.0, bins=6)
    return out.select("band", "above", "upto", "n", r6(F.col("mean_better")).alias("mean_better"), r6(F.col("mean_left")).alias("mean_left"))


EVALUATION = f"""WITH s AS ({SCENES}), b AS (SELECT CAST(ceil((snr + 12.0) / 3.0) - 1 AS INTEGER) AS band, greatest(l_discount, l_tax) AS b, l_discount AS l FROM lineitem JOIN s ON o_orderkey = l_orderkey)
SELECT CAST(e.band AS INTEGER) AS band, -12.0::DOUBLE + e.band * 3.0::DOUBLE AS above, -12.0::DOUBLE + (e.band + 1) * 3.0::DOUBLE AS upto, count(b.band) AS n, {q6("avg(b)")} AS mean_better, {q6("avg(l)")} AS mean_left
FROM range(6) AS e(band) LEFT JOIN b ON b.band = e.band GROUP BY e.band"""

#: Vectors that are joined to one signal.
JOINED = 128


def intelligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 128 vectors each, the right ear four samples late, with noise in both: binaural (a coarse grid) and left-ear measures."""
    rows = _signals(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / JOINED).alias("signal")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("v"))
    left = F.flatten(F.transform("v", lambda v: v["x"]))
    rows = rows.select("signal", left.alias("left")).withColumn("right", F.concat(F.array_repeat(F.lit(0.0), 4), F.slice("left", F.lit(1), F.size("left") - 4)))
    noise = F.reverse("left")
    noisy = lambda c: F.zip_with(c, noise, lambda x, n: x + n * 0.5).alias(f"{c}_noisy")
    rows = rows.select("signal", "left", "right", noisy("left"), noisy("right")).repartition("signal")
    scored = mbstoi.scored(rows, rate=10_000, s=mbstoi.Settings(taus=20, gammas=10))
    out = stoi.scored(scored, rate=10_000, clean_col="left", processed_col="left_noisy")
    return out.select("signal", F.size("left").alias("samples"), r6(F.col("mbstoi")).alias("mbstoi"), r6(F.col("stoi")).alias("stoi"))


def speech_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 128 vectors each with noise, heard with a loss of hearing by the first vector; the model's noise is seeded by the signal."""
    rows = _signals(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / JOINED).alias("signal")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("v"))
    rows = rows.select("signal", F.flatten(F.transform("v", lambda v: v["x"])).alias("reference"))
    rows = rows.withColumns(
        {
            "processed": F.zip_with("reference", F.reverse("reference"), lambda x, n: x + n * 0.3),
            "levels": F.transform(F.slice("reference", 1, 6), lambda v: F.abs(v) * 300),
            "seed": md5_seed(F.col("signal").cast("string")),
        }
    ).repartition("signal")
    return quality.scored(rows, "hasqi", rate=16_000, seed_col="seed").select("signal", r6(F.col("hasqi")).alias("hasqi"))


QUERIES = {f.__name__: f for f in (scene_table, loudness_report, aligned_pairs, evaluation, intelligibility, speech_quality)}
SQL = {"scene_table": SCENES, "evaluation": EVALUATION}
