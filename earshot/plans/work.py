"""Queries of work lists, keys, splits and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import text as X
from earshot.functions.keys import md5_seed, seeded_order, split_of
from earshot.operators import framing, splits, transcripts, worklist
from earshot.plans.common import q6, r6, table


def work_list_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers times the nations of a region (a bounded dimension), less those with orders, every seventh."""
    regions = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    work = table(spark, sf_dir, "customer").select("c_custkey").join(F.broadcast(regions))
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.pmod("o_orderkey", F.lit(25)).cast("int").alias("n_nationkey"))
    left = worklist.pending(work, done, ["c_custkey", "n_nationkey"])
    return worklist.stripe(left, ["c_custkey", "n_nationkey"], 2, 7)


WORK = """WITH w AS (SELECT c_custkey, n_nationkey FROM customer, nation WHERE n_regionkey = 1),
p AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = w.c_custkey AND o.o_orderkey % 25 = w.n_nationkey)),
r AS (SELECT *, row_number() OVER (ORDER BY c_custkey, n_nationkey) - 1 AS rn FROM p)
SELECT c_custkey, n_nationkey FROM r WHERE rn % 7 = 2"""


def slice_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from the 101st on, by date and key."""
    return worklist.sliced(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey")


SLICE = "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn > 100"


def md5_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", md5_seed(F.col("c_name")).alias("seed"), split_of(F.col("c_custkey")).alias("split"))


_HALF = lambda at: f"('0x' || substr(md5(c_name), {at}, 16))::UBIGINT::HUGEINT % 100000000"
MD5 = f"""SELECT c_custkey, CAST((({_HALF(1)}) * (18446744073709551616::HUGEINT % 100000000) + ({_HALF(17)})) % 100000000 AS BIGINT) AS seed,
CASE WHEN c_custkey > 0 AND c_custkey < 49999 THEN 'train' WHEN c_custkey > 50000 AND c_custkey < 59999 THEN 'valid' ELSE 'test' END AS split FROM customer"""


def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers and of urgent orders that occur once in both together: customers without such an order."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return worklist.once(customers, orders, ["k"])


MISSING = "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY k HAVING count(*) = 1"


def pair_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return worklist.set_check(customers, orders, ["k"])


SET_CHECK = """SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS in_both,
(SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_first,
(SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_second"""


def disjoint_train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return worklist.disjoint_counts(rows, ["doc_id", "source", "lang"])


DISJOINT = """SELECT a.doc_id, a.source, a.lang, (SELECT count(*) FROM documents b WHERE a.doc_id IS DISTINCT FROM b.doc_id AND a.source IS DISTINCT FROM b.source AND a.lang IS DISTINCT FROM b.lang) AS n_train FROM documents a"""


def seeded_shuffle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 5, 7)


SHUFFLE = "SELECT * FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 5"


def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a length belong together, as responses to a prompt do."""
    rows = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("prompt"))
    return splits.prompt_split(rows, "prompt", 600, 3)


PROMPT = """WITH g AS (SELECT n_chars AS prompt, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT prompt, n, CAST(coalesce(sum(n) OVER (ORDER BY md5('3:' || prompt), prompt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g)
SELECT prompt, n, before, CASE WHEN before < 600 THEN 'train' ELSE 'valid' END AS split FROM s"""


def hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return splits.hold_out(rows, "o_custkey", 0.2, 11)


HOLD_OUT = """WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('11:' || o_custkey), o_custkey) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, o_custkey, rn < floor(n * 0.2) AS held_out FROM orders JOIN k USING (o_custkey)"""


def scene_cycle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes (orders) with rooms (suppliers) in turn."""
    scenes = table(spark, sf_dir, "orders").select("o_orderkey")
    rooms = table(spark, sf_dir, "supplier").select("s_suppkey")
    out = worklist.cycled(scenes, ["o_orderkey"], rooms, ["s_suppkey"])
    return out.select(F.format_string("S%05d", F.col("i") + 1).alias("scene"), "o_orderkey", "s_suppkey")


CYCLE = """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS j, count(*) OVER () AS n FROM supplier)
SELECT printf('S%05d', i + 1) AS scene, o_orderkey, s_suppkey FROM o JOIN s ON i % n = j"""


def range_candidate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order line, the part of its brand's number that is large enough and first in the seeded order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Brand#"), (F.pmod("l_partkey", F.lit(5)) + 1).cast("string")).alias("p_brand"), "l_quantity")
    pool = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")
    return worklist.nearest_candidate(lines, pool, equal=["p_brand"], need="l_quantity", have="p_size", order=seeded_order(5, F.col("p_partkey")), pick=["p_partkey"])


PICK = """WITH l AS (SELECT l_orderkey, l_linenumber, 'Brand#' || (l_partkey % 5 + 1) AS p_brand, l_quantity FROM lineitem),
k AS (SELECT DISTINCT p_brand, l_quantity FROM l),
b AS (SELECT k.p_brand, k.l_quantity, arg_min(p.p_partkey, md5('5:' || p.p_partkey)) AS p_partkey FROM k JOIN part p ON p.p_brand = k.p_brand AND p.p_size >= k.l_quantity GROUP BY ALL)
SELECT l.*, b.p_partkey FROM l LEFT JOIN b USING (p_brand, l_quantity)"""


def ear_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a row as rows of a left and a right ear."""
    rows = table(spark, sf_dir, "lineitem")
    ears = F.array(F.struct(F.lit("left").alias("ear"), F.col("l_discount").alias("score")), F.struct(F.lit("right").alias("ear"), F.col("l_tax").alias("score")))
    return rows.select("l_orderkey", "l_linenumber", F.inline(ears))


UNPIVOT = "SELECT l_orderkey, l_linenumber, 'left' AS ear, l_discount AS score FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'right', l_tax FROM lineitem"


def channel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of an order as channels, and their mean."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.sum("l_quantity"))
    channels = [F.col(f"`{i}`") for i in (1, 2, 3)]
    known = sum((c.isNotNull().cast("int") for c in channels), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in channels), F.lit(0.0)), known)
    return rows.select("l_orderkey", *[r6(c).alias(f"ch{i}") for i, c in zip((1, 2, 3), channels, strict=True)], r6(mean).alias("mean"))


PIVOT = f"""SELECT l_orderkey, {", ".join(f"{q6(f'sum(l_quantity) FILTER (l_linenumber = {i})')} AS ch{i}" for i in (1, 2, 3))},
{q6("sum(l_quantity) FILTER (l_linenumber IN (1, 2, 3)) / nullif(count(DISTINCT l_linenumber) FILTER (l_linenumber IN (1, 2, 3)), 0)")} AS mean FROM lineitem GROUP BY l_orderkey"""


def better_ear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two scores, its side (ties to the left), and a weighted composite."""
    left, right = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.greatest(left, right).alias("score"), F.when(left >= right, "left").otherwise("right").alias("ear"), r6(0.5 * left + 0.5 * right).alias("combined")
    )


BETTER = f"SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS score, CASE WHEN l_discount >= l_tax THEN 'left' ELSE 'right' END AS ear, {q6('0.5 * l_discount + 0.5 * l_tax')} AS combined FROM lineitem"


def key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.get(parts, 2).alias("host"), F.get(parts, F.size(parts) - 2).alias("folder"), F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "_").alias("rest"), F.regexp_extract("url", r"\d+", 0).alias("number")
    )


KEY_PARSE = r"""SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[-2] AS folder, array_to_string(string_split(url, '/')[4:], '_') AS rest, regexp_extract(url, '\d+', 0) AS number FROM pages"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before it in its conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return framing.shifted(turns, ["conv_id"], ["turn", "role", "text"], "text", 1, "before", default=None).where("before is not null")


def transcript_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised transcripts and their number of words."""
    clean = X.normalised(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", clean.alias("normal"))
    return rows.select("conv_id", "turn", "normal", F.size(X.words(F.col("normal"))).alias("n_words"))


_TOKEN = X.TOKEN.replace("'", "''")
_CLEAN = f"""trim(regexp_replace(upper(regexp_replace(array_to_string(regexp_extract_all(lower(regexp_replace(text, '{X.SYMBOLS}', '', 'g')), '{_TOKEN}'), ' '), '{X.NON_WORDS}', '', 'g')), '\\s+', ' ', 'g'))"""
WORDS_SQL = f"SELECT conv_id, turn, n AS normal, CAST(len(list_filter(string_split(n, ' '), lambda w: w <> '')) AS INTEGER) AS n_words FROM (SELECT conv_id, turn, {_CLEAN} AS n FROM conversations)"


def transcript_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the transcript of the one before it."""
    out = transcripts.scored(_replies(spark, sf_dir), "before", "text")
    counts = [f"score.{c}" for c in ("hits", "substitutions", "deletions", "insertions")]
    return out.select("conv_id", "turn", *counts, r6(F.col("score.correctness")).alias("correctness"))


def _aligned_sql(pairs: str) -> str:
    """``counts`` of the rows of ``pairs`` (k, r, h: lists of words), a step for each diagonal of their table of costs: ``d`` is the last one by places in r, ``e`` the one before."""
    return f"""g AS (
  SELECT k, r, h, CAST(len(r) + len(h) + 1 AS BIGINT) AS unit, CAST(0 AS BIGINT) AS s, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i = 0 THEN 0::BIGINT END) AS d, [NULL::BIGINT] AS e FROM {pairs}
  UNION ALL
  SELECT k, r, h, unit, s + 1, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > len(h) THEN NULL WHEN i = 0 OR i = s + 1 THEN (s + 1) * unit
    ELSE least(d[i + 1] + unit, d[i] + unit, e[i] + CASE WHEN r[i] = h[s + 1 - i] THEN -1 ELSE unit END) END), d
  FROM g WHERE s < len(r) + len(h)
), c AS (
  SELECT k, len(r) AS nr, len(h) AS nh, CAST(ceil(d[-1] / unit) AS BIGINT) AS cost, CAST(ceil(d[-1] / unit) AS BIGINT) * unit - d[-1] AS hits FROM g WHERE s = len(r) + len(h)
), counts AS (SELECT k, CAST(hits AS INTEGER) AS hits, CAST(nr + nh - 2 * hits - cost AS INTEGER) AS substitutions, CAST(cost - nh + hits AS INTEGER) AS deletions, CAST(cost - nr + hits AS INTEGER) AS insertions, nr FROM c)"""


def _words_sql(text: str, tokens: str = "{}") -> str:
    """Normalised words of a text; ``tokens`` is put around the list of tokens."""
    found = tokens.format(f"regexp_extract_all(lower(regexp_replace({text}, '{X.SYMBOLS}', '', 'g')), '{_TOKEN}')")
    return f"list_filter(string_split(trim(regexp_replace(upper(regexp_replace(array_to_string({found}, ' '), '{X.NON_WORDS}', '', 'g')), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


_BEFORE = "SELECT conv_id, turn, text, lag(text) OVER w AS before, lag(text, 2) OVER w AS earlier FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"
HITS = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER () AS k, conv_id, turn, {_words_sql("before")} AS r, {_words_sql("coalesce(text, '')")} AS h FROM ({_BEFORE}) WHERE before IS NOT NULL),
{_aligned_sql("p")}
SELECT conv_id, turn, hits, substitutions, deletions, insertions, {q6("CASE WHEN nr > 0 THEN hits / nr END")} AS correctness FROM counts JOIN p USING (k)"""

#: A small table of contractions for the query; one is written out with a number.
WRITTEN = {"the": "th'", "and": "and then", "for": "4", "of": ""}


def transcript_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn, whole or up to its first full stop, as the transcript of either of the two turns before it; contractions written out."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    order = ["turn", "role", "text"]
    rows = framing.shifted(turns, ["conv_id"], order, "text", 1, "before", default=None)
    rows = framing.shifted(rows, ["conv_id"], order, "text", 2, "earlier", default=None).where("before is not null")
    said = F.array_compact(F.array("before", "earlier"))
    heard = F.array_compact(F.array("text", F.substring_index("text", ".", 1)))
    out = transcripts.scored(rows.withColumns({"said": said, "heard": heard}), "said", "heard", contractions=WRITTEN)
    return out.select("conv_id", "turn", "score.*").withColumn("correctness", r6(F.col("correctness")))


_WRITTEN = "list_transform({}, lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{X.with_numbers_spoken(v).replace(chr(39), chr(39) * 2)}'" for k, v in WRITTEN.items()) + " ELSE w END)"
ALTERNATIVES = f"""WITH RECURSIVE a AS (SELECT row_number() OVER () AS id, *, CASE WHEN earlier IS NULL THEN [before] ELSE [before, earlier] END AS said, CASE WHEN text IS NULL THEN [] ELSE [text, split_part(text, '.', 1)] END AS heard FROM ({_BEFORE}) WHERE before IS NOT NULL),
f AS (SELECT id, conv_id, turn, unnest(said) AS s, generate_subscripts(said, 1) - 1 AS reference, heard FROM a),
p AS MATERIALIZED (SELECT row_number() OVER () AS k, id, conv_id, turn, reference, hypothesis, {_words_sql("s", _WRITTEN)} AS r, {_words_sql("t", _WRITTEN)} AS h FROM (SELECT * EXCLUDE (heard), unnest(heard) AS t, generate_subscripts(heard, 1) - 1 AS hypothesis FROM f)),
{_aligned_sql("p")},
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, hypothesis, reference) AS n FROM counts JOIN p USING (k))
SELECT conv_id, turn, hits, substitutions, deletions, insertions, CAST(reference AS INTEGER) AS reference, CAST(hypothesis AS INTEGER) AS hypothesis, {q6("CASE WHEN nr > 0 THEN hits / nr END")} AS correctness FROM best WHERE n = 1
UNION ALL SELECT conv_id, turn, 0, 0, 0, 0, NULL, NULL, NULL FROM a WHERE text IS NULL"""


QUERIES = {
    f.__name__: f
    for f in (work_list_batch, slice_limit, md5_seeds, missing_pairs, pair_set_check, disjoint_train_counts, seeded_shuffle_topk, prompt_split, hold_out)
    + (scene_cycle_join, range_candidate_pick, ear_unpivot, channel_pivot, better_ear, key_parse, transcript_words, transcript_hits, transcript_alternatives)
}
SQL = {
    "work_list_batch": WORK,
    "slice_limit": SLICE,
    "md5_seeds": MD5,
    "missing_pairs": MISSING,
    "pair_set_check": SET_CHECK,
    "disjoint_train_counts": DISJOINT,
    "seeded_shuffle_topk": SHUFFLE,
    "prompt_split": PROMPT,
    "hold_out": HOLD_OUT,
    "scene_cycle_join": CYCLE,
    "range_candidate_pick": PICK,
    "ear_unpivot": UNPIVOT,
    "channel_pivot": PIVOT,
    "better_ear": BETTER,
    "key_parse": KEY_PARSE,
    "transcript_words": WORDS_SQL,
    "transcript_hits": HITS,
    "transcript_alternatives": ALTERNATIVES,
}
