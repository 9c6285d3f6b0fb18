"""Queries of small relational forms and level expressions, each with its SQL."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import arrays as A
from earshot.functions import levels as L
from earshot.functions.draws import MIDDLE, TAIL
from earshot.operators import merging
from earshot.operators.scenes import bounded_gauss
from earshot.operators.splits import weighted_sample
from earshot.operators.worklist import numbered_rows
from earshot.plans.common import q6, r6, table

_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_HEX = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("x"))


def presence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label from its own column where there is one, else from the dimension."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    degree = F.when(F.col("toxic").isNotNull(), F.when(F.col("toxic") == 1, "Moderate").otherwise("Mild")).otherwise("Moderately severe")
    named = docs.select("doc_id").join(labels.select("doc_id", "toxic"), "doc_id", "left").withColumn("degree", degree)
    return named.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


PRESENCE = """SELECT CASE WHEN toxic IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'Moderate' ELSE 'Mild' END ELSE 'Moderately severe' END AS degree, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""


def standard_audiograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard levels of customers' degrees of loss, and their mean."""
    degree = F.element_at(F.array(*[F.lit(d) for d in L.STANDARD_LOSS]), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", degree.alias("degree")).withColumn("levels", L.standard_levels(F.col("degree")))
    return rows.select("c_custkey", "degree", F.array_join(F.transform("levels", lambda v: v.cast("int").cast("string")), ",").alias("levels"), r6(A.mean(F.col("levels"))).alias("mean_loss"))


_DEGREES = ", ".join(f"({i}, '{name}', {list(levels)})" for i, (name, levels) in enumerate(L.STANDARD_LOSS.items()))
STANDARD = f"""SELECT c_custkey, degree, array_to_string(levels, ',') AS levels, {q6("list_avg(levels)")} AS mean_loss
FROM customer JOIN (VALUES {_DEGREES}) AS d(i, degree, levels) ON c_custkey % 3 = i"""


def map_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.map_from_arrays(F.array(*[F.lit(f"s{i}") for i in range(5)]), F.slice("x", 1, 5))
    return _signals(spark, sf_dir).select("vec_id", r6(L.mean_of_map(scores)).alias("score"))


MAP_MEAN = f"SELECT vec_id, {q6(f'list_sum({_E}[1:5]) / 5')} AS score FROM embeddings"


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = L.class_index(F.col("lang"), ("en", "de"))
    return table(spark, sf_dir, "documents").select(index.alias("lang_index")).groupBy("lang_index").agg(F.count(F.lit(1)).alias("n"))


LABEL_INDEX = "SELECT CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS lang_index, count(*) AS n FROM documents GROUP BY 1"


def loudness_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = (F.col("c_custkey") % 80).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", r6(L.target_loudness(loss, -14.0, -19.0)).alias("target"))


LOUDNESS_TARGET = f"SELECT c_custkey, {q6('CASE WHEN c_custkey % 80 >= 50 THEN -19.0 - greatest((c_custkey % 80 - 50) / 5, 0) ELSE -14.0 END')} AS target FROM customer"


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work item with its scene, listener, region and gain; the small dimensions are broadcast by their size."""
    t = lambda name: table(spark, sf_dir, name)
    items = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    rows = items.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = rows.join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey")), "l_suppkey")
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("s_nationkey") == F.col("c_nationkey")).cast("long")).alias("near"))


STAR = """SELECT n_name, count(*) AS n, CAST(sum(CASE WHEN s_nationkey = c_nationkey THEN 1 ELSE 0 END) AS BIGINT) AS near
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY n_name"""


def zip_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = L.strict_zip(F.slice("x", 1, 8), F.slice("x", 9, 8))
    return _signals(spark, sf_dir).select("vec_id", r6(A.total(F.transform(pairs, lambda p: p["a"] * p["b"]))).alias("dot"))


ZIP_STRICT = f"SELECT vec_id, {q6(f'list_dot_product({_E}[1:8], {_E}[9:16])')} AS dot FROM embeddings"


def complete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is known and that have an item: two semi joins, as records against listings of files."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("orders").select("o_orderkey", "o_custkey").join(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    rows = rows.join(t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return rows.select("o_orderkey")


COMPLETE = "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"


def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the dimension lacks, with how often each occurs."""
    known = spark.createDataFrame([("en",), ("de",)], "lang string")
    return table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(known, "lang", "left_anti")


UNKNOWN = "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'de') GROUP BY lang"


def last_score_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last score of each key of a score file."""
    last = merging.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


LAST_SCORE = f"SELECT event_type, count(*) AS n, {q6('avg(v)')} AS mean FROM (SELECT event_type, user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1"


def rms_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMS over the signals of a label, sample by sample."""
    rows = _signals(spark, sf_dir).select("label", F.posexplode("x").alias("axis", "v"))
    return rows.groupBy("label", "axis").agg(r6(F.sqrt(F.avg(F.col("v") * F.col("v")))).alias("rms"))


RMS_AXIS = f"SELECT label, CAST(i - 1 AS INTEGER) AS axis, {q6('sqrt(avg(v * v))')} AS rms FROM (SELECT label, unnest({_E}) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2"


def mean_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", r6(L.mean_gain_undone(F.transform(F.slice("x", 1, 4), lambda v: v * 10))).alias("gain_db"))


MEAN_GAIN = f"SELECT vec_id, {q6(f'-10 * log10(list_sum(list_transform({_E}[1:4], lambda g: pow(10, g))) / 4)')} AS gain_db FROM embeddings"


def draws_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty suppliers drawn with replacement, numbered by key."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    numbered = numbered_rows(rows, ["s_suppkey"], "n")
    return merging.drawn(numbered, rows.count(), 50, 11).select("draw", "s_suppkey")


DRAWS = f"""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier)
SELECT draw, s_suppkey FROM (SELECT unnest(range(50)) AS draw) JOIN s ON n = {_HEX.format("'11:' || draw")} % (SELECT count(*) FROM supplier)"""


def merge_right_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    left = parts.where("p_partkey % 2 = 0").select("p_partkey", F.lit("left").alias("side"))
    right = parts.where("p_partkey % 3 = 0").select("p_partkey", F.lit("right").alias("side"))
    return merging.merged(left, right, ["p_partkey"])


MERGE = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'right' ELSE 'left' END AS side FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"


def reference_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", r6(L.reference_level(A.rms(F.col("x")))).alias("level"))


_RMS = f"sqrt(list_sum(list_transform({_E}, lambda x: x * x)) / len(embedding))"
REFERENCE = f"SELECT vec_id, {q6(f'65 - 20 * log10({_RMS})')} AS level FROM embeddings"


def smooth_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("x", lambda v: L.smoothstep(v, -0.2, 0.3, 2))
    return _signals(spark, sf_dir).select("vec_id", r6(A.total(x)).alias("steps"))


_T = "least(greatest((x + 0.2) / (0.3 - -0.2), 0), 1)"
SMOOTH = f"SELECT vec_id, {q6(f'list_sum(list_transform({_E}, lambda x: pow({_T}, 3) * (10 - 15 * {_T} + 6 * pow({_T}, 2))))')} AS steps FROM embeddings"


def rotation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 20).cast("int").alias("a"))
    at = L.rotation_indices(64, F.col("a"), F.col("a") + 31)
    return rows.select("s_suppkey", F.array_join(F.transform(at, lambda i: i.cast("string")), ",").alias("steps"))


_Q = "least(greatest((i - a) / 31.0::DOUBLE, 0), 1)"
ROTATION = f"""SELECT s_suppkey, array_to_string(list_transform(range(64), lambda i: CAST(floor((-2.0 * {_Q} + 3) * {_Q} * {_Q} * 63) AS INTEGER)), ',') AS steps
FROM (SELECT s_suppkey, s_suppkey % 20 AS a FROM supplier)"""


def rotation_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angles of such a turn, from the supplier's number below 90 to as many degrees more as it is below 20."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 20).cast("int").alias("a"), (F.col("s_suppkey") % 90).cast("double").alias("first"))
    angles = L.turn_angles(L.rotation_indices(64, F.col("a"), F.col("a") + 31), 64, F.col("first"), F.col("first") + F.col("a"))
    return rows.select("s_suppkey", r6(F.element_at(angles, 1)).alias("begins"), r6(F.element_at(angles, 32)).alias("halfway"), r6(A.total(angles)).alias("angles"))


_ANGLE = f"(f + a * floor((-2.0 * {_Q} + 3) * {_Q} * {_Q} * 63) / 63.0::DOUBLE)"
ANGLES = f"""WITH s AS (SELECT s_suppkey, s_suppkey % 20 AS a, (s_suppkey % 90)::DOUBLE AS f FROM supplier), t AS (SELECT s_suppkey, list_transform(range(64), lambda i: {_ANGLE}) AS t FROM s)
SELECT s_suppkey, {q6("t[1]")} AS begins, {q6("t[32]")} AS halfway, {q6("list_sum(t)")} AS angles FROM t"""


def remix(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = (F.col("vec_id") % 11).cast("double") / 10
    out = L.remixed(F.slice("x", 1, 32), F.slice("x", 33, 32), beta)
    return _signals(spark, sf_dir).select("vec_id", r6(A.rms(out)).alias("rms"))


REMIX = f"""WITH s AS (SELECT vec_id, {_E} AS e, pow((vec_id % 11) / 10.0::DOUBLE, 2) + 1 AS v FROM embeddings)
SELECT vec_id, {q6("sqrt(list_sum(list_transform(range(1, 33), lambda i: pow(e[i] * v + e[i + 32] * (2 - v), 2))) / 32)")} AS rms FROM s"""


def equalised_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merging.equalised(_signals(spark, sf_dir).withColumn("rms", A.rms(F.col("x"))), ["label"], F.col("rms"), "x", "y")
    return rows.select("vec_id", r6(A.rms(F.col("y"))).alias("rms"))


EQUALISED = f"SELECT vec_id, {q6('max(r) OVER (PARTITION BY label)')} AS rms FROM (SELECT vec_id, label, {_RMS} AS r FROM embeddings)"


def matched_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of a signal at the level of the first."""
    one, two = F.slice("x", 1, 32), F.slice("x", 33, 32)
    return _signals(spark, sf_dir).select("vec_id", r6(A.total(L.at_level_of(two, two, one))).alias("total"))


_HALF = lambda a, b: f"sqrt(list_sum(list_transform(e[{a}:{b}], lambda x: x * x)) / 32)"
MATCHED = f"WITH s AS (SELECT vec_id, {_E} AS e FROM embeddings) SELECT vec_id, {q6(f'list_sum(e[33:64]) * {_HALF(1, 32)} / {_HALF(33, 64)}')} AS total FROM s"


def keyed_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty samples of each signal after four of silence, from a place that its id fixes."""
    part = L.cropped(F.col("x"), 20, F.col("vec_id").cast("string"), silence=4)
    return _signals(spark, sf_dir).select("vec_id", r6(A.total(part)).alias("total"))


CROPS = f"WITH s AS (SELECT vec_id, {_E} AS e, {_HEX.format('vec_id::VARCHAR')} % 41 + 5 AS a FROM embeddings) SELECT vec_id, {q6('list_sum(e[a:a + 19])')} AS total FROM s"


def keyed_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gain from 0.25 to 1.25 and a swap of channels that an id fixes."""
    key = F.col("vec_id").cast("string")
    gain = F.lit(0.25) + L.keyed_number(F.concat(F.lit("gain:"), key), 1 << 20) / float(1 << 20)
    swap = L.keyed_number(F.concat(F.lit("swap:"), key), 2) == 1
    left, right = F.slice("x", 1, 32), F.slice("x", 33, 32)
    first = F.when(swap, right).otherwise(left)
    return _signals(spark, sf_dir).select("vec_id", swap.alias("swapped"), r6(A.rms(F.transform(first, lambda v: v * gain))).alias("left_rms"))


KEYED_GAINS = f"""WITH s AS (SELECT vec_id, {_E} AS e, 0.25 + ({_HEX.format("'gain:' || vec_id")} % 1048576) / 1048576.0::DOUBLE AS g, {_HEX.format("'swap:' || vec_id")} % 2 = 1 AS w FROM embeddings)
SELECT vec_id, w AS swapped, {q6(f"g * CASE WHEN w THEN {_HALF(33, 64)} ELSE {_HALF(1, 32)} END")} AS left_rms FROM s"""


def repeated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of five sources by their labels, the first letters of what the components are above: repeated ones share a mean."""
    gains = F.slice("x", 1, 5)
    labels = F.transform(gains, lambda v: F.when(v > 0.1, "violin").when(v > 0, "viola").when(v > -0.1, "cello").otherwise("flute"))
    rows = _signals(spark, sf_dir).select("vec_id", L.shared_gains(gains, labels).alias("g"))
    return rows.select("vec_id", *[r6(F.element_at("g", i)).alias(f"gain_{i}") for i in range(1, 6)])


REPEATED = f"""WITH s AS (SELECT vec_id, {_E}[1:5] AS g FROM embeddings),
l AS (SELECT vec_id, g, list_transform(g, lambda v: CASE WHEN v > 0.1 THEN 'violin' WHEN v > 0 THEN 'viola' WHEN v > -0.1 THEN 'cello' ELSE 'flute' END) AS l FROM s),
t AS (SELECT vec_id, g, list_transform(l, lambda a: len(list_filter(l, lambda b: b = a)) > 1) AS t FROM l),
m AS (SELECT vec_id, g, t, list_avg(list_transform(list_filter(range(1, 6), lambda i: t[i]), lambda i: g[i])) AS m FROM t)
SELECT vec_id, {", ".join(f"{q6(f'CASE WHEN t[{i}] THEN m ELSE g[{i}] END')} AS gain_{i}" for i in range(1, 6))} FROM m"""


def four_way_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of either ear with either reference, quarters of a vector each, and the references' squared error."""
    quarter = lambda i: F.slice("x", 16 * i + 1, 16)
    best = L.best_of_ears(*[quarter(i) for i in range(4)], A.cosine)
    error = A.let(quarter(2), lambda a: A.energy(F.zip_with(a, quarter(3), lambda u, v: u - v)) / 16)
    return _signals(spark, sf_dir).select("vec_id", r6(best).alias("match"), r6(error).alias("error"))


_COSINE = lambda a, b: f"list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
FOUR_WAY = f"""WITH s AS (SELECT vec_id, {_E} AS e FROM embeddings), q AS (SELECT vec_id, e[1:16] AS a, e[17:32] AS b, e[33:48] AS c, e[49:64] AS d FROM s)
SELECT vec_id, {q6(f"greatest({_COSINE('c', 'a')}, {_COSINE('c', 'b')}, {_COSINE('d', 'a')}, {_COSINE('d', 'b')})")} AS match,
{q6("(list_dot_product(c, c) - 2 * list_dot_product(c, d) + list_dot_product(d, d)) / 16")} AS error FROM q"""


def delayed_ears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of a vector as references of two ears, each later by where its greatest sample lies, and how they go together then."""
    left, right = F.slice("x", 1, 32), F.slice("x", 33, 32)
    late = L.delayed_references(left, right, A.first_argmax(left).cast("int"), A.first_argmax(right).cast("int"))
    rows = _signals(spark, sf_dir).select("vec_id", late.alias("d"))
    return rows.select("vec_id", F.size("d.left").alias("n"), r6(A.dot(F.col("d.left"), F.col("d.right"))).alias("product"))


DELAYED = f"""WITH s AS (SELECT vec_id, {_E} AS e FROM embeddings), h AS (SELECT vec_id, e[1:32] AS a, e[33:64] AS b FROM s),
k AS (SELECT vec_id, a, b, list_position(a, list_max(a)) - 1 AS i, list_position(b, list_max(b)) - 1 AS j FROM h)
SELECT vec_id, CAST(32 + greatest(i, j) AS INTEGER) AS n, {q6("coalesce(list_sum(list_transform(range(greatest(i, j), 32 + least(i, j)), lambda t: a[t - i + 1] * b[t - j + 1])), 0.0)")} AS product FROM k"""


_TURN = "(('0x' || substr(md5('21:turn:' || o_orderkey), 1, 16))::UBIGINT::HUGEINT % 100000000 * (18446744073709551616::HUGEINT % 100000000) + ('0x' || substr(md5('21:turn:' || o_orderkey), 17, 16))::UBIGINT::HUGEINT % 100000000) % 100000000"


def rotation_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of the head for each order: normal, within three standard deviations."""
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(bounded_gauss(F.col("o_orderkey"), "turn", 21, 7.5, 22.5)).alias("turn"))


def _ratio_sql(x: str, of: tuple) -> str:
    polynomial = lambda factors: reduce(lambda total, f: f"({total}) * {x} + {f!r}::DOUBLE", factors[-2::-1], f"{factors[-1]!r}::DOUBLE")
    return f"({polynomial(of[0])}) / ({polynomial(of[1])})"


_LOW = NormalDist().cdf(-3.0)
TURNS = f"""WITH u AS (SELECT o_orderkey, {_LOW!r}::DOUBLE + ((CAST({_TURN} AS DOUBLE) + 0.5) / 1e8) * {1 - 2 * _LOW!r}::DOUBLE AS p FROM orders),
r AS (SELECT o_orderkey, p - 0.5 AS q, 0.180625::DOUBLE - (p - 0.5) * (p - 0.5) AS m, sqrt(-ln(least(p, 1 - p))) - 1.6 AS t FROM u)
SELECT o_orderkey, {q6(f"7.5 * CASE WHEN abs(q) <= 0.425 THEN q * ({_ratio_sql('m', MIDDLE)}) WHEN q < 0 THEN -({_ratio_sql('t', TAIL)}) ELSE {_ratio_sql('t', TAIL)} END")} AS turn FROM r"""


def weighted_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five orders of each priority, drawn by price."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return weighted_sample(rows, ["o_orderpriority"], "o_orderkey", "o_totalprice", 5, 21).select("o_orderpriority", "rank", "o_orderkey")


WEIGHTED = f"""SELECT o_orderpriority, CAST(rank AS INTEGER) AS rank, o_orderkey FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY -ln((CAST({_TURN.replace(":turn:", ":weighted:")} AS DOUBLE) + 0.5) / 1e8) / o_totalprice, o_orderkey) AS rank FROM orders WHERE o_totalprice > 0)
WHERE rank <= 5"""


_ALL = (
    (presence_flag, PRESENCE),
    (standard_audiograms, STANDARD),
    (map_mean, MAP_MEAN),
    (label_index, LABEL_INDEX),
    (loudness_target, LOUDNESS_TARGET),
    (star_join, STAR),
    (zip_strict, ZIP_STRICT),
    (complete_records, COMPLETE),
    (unknown_labels, UNKNOWN),
    (last_score_mean, LAST_SCORE),
    (rms_by_axis, RMS_AXIS),
    (mean_gain, MEAN_GAIN),
    (draws_with_replacement, DRAWS),
    (merge_right_wins, MERGE),
    (reference_levels, REFERENCE),
    (smooth_steps, SMOOTH),
    (rotation_steps, ROTATION),
    (rotation_angles, ANGLES),
    (remix, REMIX),
    (equalised_levels, EQUALISED),
    (matched_levels, MATCHED),
    (keyed_crops, CROPS),
    (keyed_gains, KEYED_GAINS),
    (repeated_sources, REPEATED),
    (four_way_match, FOUR_WAY),
    (delayed_ears, DELAYED),
    (rotation_draws, TURNS),
    (weighted_picks, WEIGHTED),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
SQL = {f.__name__: sql for f, sql in _ALL}
