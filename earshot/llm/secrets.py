"""Secret scans over an incremental, content-addressed ledger of blobs.

A blob is a distinct text, named by its SHA-256. The ledger holds, for each blob
and version of a rule, the spans found. A scan looks only at pairs of blob and
rule version that the ledger lacks, and joins findings back to every path (row)
that holds the blob. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import checkpointed, fresh_names, salted_join, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; those whose ``group`` has under ``least`` characters are dropped.

    ``hint`` is a cheaper pattern without which the rule can't match.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN_WORDS = r"(?i:password|passwd|secret|token|api_?key)"
#: The first three are the base kinds. Runs are greedy, so a least length within the pattern finds the same runs.
RULES = (
    Rule("assign", rf"({_ASSIGN_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6, hint=_ASSIGN_WORDS),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox[abprs]-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="-----BEGIN "),
)
BASE = ("assign", "access", "hex")

SPAN = "struct<start:bigint,place:bigint,end:bigint,kind:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of 0 and all earlier values, for each of an array of long.

    The array is folded in about as many pieces as a piece has values: an array
    grows by a copy, so that one fold over n values would copy n * n of them.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    fold = lambda some, of: F.aggregate(some, zero, lambda s, x: F.struct(combine(s["at"], of(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def in_pieces(all_: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), size)
        folded = F.transform(firsts, lambda i: fold(F.slice(all_, i, size), lambda x: x))
        starts = lambda pieces: fold(pieces, lambda x: x["at"])["out"]
        return _let(folded, lambda pieces: F.flatten(F.zip_with(pieces, starts(pieces), lambda p, start: F.transform(p["out"], lambda x: combine(start, x)))))

    return _let(values, in_pieces)


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule: between n matches lie n + 1 pieces of text, whose lengths give the offsets."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.lit(None)
    pieces = F.split(text, rule.pattern, -1)
    long = lambda x: F.transform(x, lambda t: F.length(t).cast("bigint"))
    lengths = F.struct(long(pieces).alias("a"), long(matches).alias("b"), (long(groups) if rule.group else F.expr("cast(null as array<bigint>)")).alias("c"))

    def place_them(x: Column) -> Column:
        gaps = F.slice(x["a"], 1, F.size(x["b"]))
        kept = x["c"] if rule.group else x["b"]
        starts = F.zip_with(_before(F.zip_with(gaps, x["b"], lambda g, b: g + b), lambda s, y: s + y), gaps, lambda s, g: s + g)
        spans = F.zip_with(starts, x["b"], lambda s, b: F.struct(s.alias("start"), F.lit(place).cast("bigint").alias("place"), (s + b).alias("end"), F.lit(rule.kind).alias("kind")))
        if not rule.least:
            return spans
        return F.filter(F.zip_with(spans, kept, lambda s, c: F.when(c >= rule.least, s)), lambda s: s.isNotNull())

    return F.when(text.rlike(rule.hint or rule.pattern), _let(lengths, place_them)).otherwise(F.expr(NONE))


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", seen_col: str | None = None) -> Column:
    """Map of rule key to spans, without the rules that ``seen_col`` (an array of keys) already has."""
    found = [(F.lit(r.key), _spans(blobs[text_col], r, i)) for i, r in enumerate(rules)]
    if seen_col is None:
        return F.map_from_arrays(F.array(*(k for k, _ in found)), F.array(*(v for _, v in found)))
    todo = lambda k, v: F.when(~F.array_contains(blobs[seen_col], k), v)
    every = F.map_from_arrays(F.array(*(k for k, _ in found)), F.array(*(todo(k, v) for k, v in found)))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, *, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger's new rows: ``blob`` (SHA-256, hex), ``found`` (map of rule key to spans), for unseen pairs only.

    ``docs`` may hold every historical version, one row each; a null text is an
    empty one. ``ledger`` is the union of what earlier scans returned (null: none).
    A blob with nothing unseen has no row, and its text is not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if ledger is None:
        # one copy of each text; copies in one task meet before the shuffle
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        return blobs.select("blob", scan(blobs, rules).alias("found"))
    keys = [r.key for r in rules]
    seen = ledger.select("blob", F.explode(F.map_keys("found")).alias("k")).where(F.col("k").isin(keys)).groupBy("blob").agg(F.collect_set("k").alias("seen"))
    full = seen.where(F.size("seen") == len(keys)).select("blob")
    fresh = blobs.join(full, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    fresh = fresh.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return fresh.select("blob", scan(fresh, rules, seen_col="seen").alias("found"))


def findings(docs: DataFrame, ledger: DataFrame, *, rules: Sequence[Rule] = RULES, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with all spans of the given rules' versions, by start, then rule.

    Blobs without findings are not joined: only the rest of the ledger is moved.
    A blob that the ledger lacks has no spans. The copies of a frequent blob are
    dealt to several tasks. A column of ``docs`` named as ``out_col`` is an error.
    """
    if out_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the input already has a column {out_col!r}; rename it first")
    blob, found, by = fresh_names(docs, "blob", "found_spans", "copy")
    keys = [r.key for r in rules]
    rows = ledger.select(F.col("blob").alias(blob), F.explode("found").alias("k", "v")).where(F.col("k").isin(keys) & (F.size("v") > 0))
    rows = rows.groupBy(blob).agg(F.sort_array(F.flatten(F.collect_list("v"))).alias("v"))
    # spans that a ledger holds twice lie side by side
    rows = rows.select(blob, _let(F.col("v"), lambda v: F.filter(v, lambda s, i: (i == 0) | (s != F.get(v, i - 1)))).alias(found))
    others = [f.name for f in docs.schema.fields if f.name != text_col and "map<" not in f.dataType.simpleString()]
    named = docs.withColumns({blob: F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256), by: F.xxhash64(F.lit(0), *(F.col(f"`{c}`") for c in others))})
    joined = salted_join(named, rows, blob, by, "left")
    return joined.select(*docs.columns, F.coalesce(found, F.expr(NONE)).alias(out_col))


def joined_spans(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of the spans, joined by commas."""
    some = F.filter(spans, lambda s: s["kind"].isin(list(kinds))) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch that spans cover, overlapping or touching ones together, replaced by ``mark``."""
    ends = F.transform(spans, lambda s: s["end"])
    # the text between what is covered so far and each span, but for spans that begin within it
    gaps = F.zip_with(spans, _before(ends, F.greatest), lambda s, at: F.struct(at.alias("a"), s["start"].alias("b")))
    cuts = F.filter(gaps, lambda g, i: (i == 0) | (g["b"] > g["a"]))
    cut = lambda t, first, end: F.substring(t, (first + 1).cast("int"), (end - first).cast("int"))

    def in_pieces(all_: Column) -> Column:
        """A cut is counted from the start of its text, so that cuts are made from pieces of the whole."""
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")

        def piece(i: Column) -> Column:
            some = F.slice(all_, i, size)
            from_, to = some[0]["a"], F.element_at(some, -1)["b"]
            return _let(F.struct(cut(text, from_, to).alias("t"), from_.alias("a"), some.alias("some")), lambda p: F.array_join(F.transform(p["some"], lambda g: F.concat(cut(p["t"], g["a"] - p["a"], g["b"] - p["a"]), F.lit(mark))), ""))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(all_), size), piece), "")

    rest = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.lit(2**31 - 1))
    return F.when(F.size(spans) > 0, F.concat(_let(cuts, in_pieces), rest)).otherwise(text)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = checkpointed(scan_ledger(docs))
    found = findings(docs, ledger).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined_spans(F.col("spans"), BASE), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def _sql_spans(kind: str, place: int, pattern: str, keep: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT rid, {place} AS place, '{kind}' AS kind,
         unnest(list_transform(range(1, len(m) + 1), lambda i:
           {{'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
             'size': length(m[i]), 'm': m[i]}})) AS s
  FROM (SELECT rid, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p FROM d)
  WHERE len(m) > 0"""


_SQL_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SQL_PATTERNS = [_SQL_ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""] + [r.pattern for r in RULES[1:]]
_SQL_VALUE = _SQL_PATTERNS[0].replace("'", "''")
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_sql_spans(r.kind, i, p) for i, (r, p) in enumerate(zip(RULES, _SQL_PATTERNS, strict=True)))}),
f AS (
  SELECT rid, place, kind, CAST(s.start AS BIGINT) AS a, CAST(s.start + s.size AS BIGINT) AS b FROM raw
  WHERE kind <> 'assign' OR length(regexp_extract(s.m, '{_SQL_VALUE}', 2)) >= 6
),
g AS (
  SELECT rid,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place < 3), '') AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
  FROM f GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
