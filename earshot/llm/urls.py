"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled pages are counted by host, registered domain (site) and suffix. The
shares of bad pages follow a nested beta-binomial model: a suffix's share varies
around the share of all pages, a site's around its suffix's, a host's around its
site's. How much each level varies is estimated from pairs of pages; each host's
share is shrunk through the three levels, and a host is blocked when the lower
bound of its posterior exceeds a limit. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import checkpointed, fresh_names, salted_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs are summed in units of 1 / PAIR_UNITS, as whole numbers, so that sums do not depend on their order.
PAIR_UNITS = float(1 << 20)
#: The bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 0.5, 1000.0
#: A host is blocked if its share of bad pages exceeds ``LIMIT`` even ``DEVIATIONS`` standard deviations below its posterior mean.
LIMIT, DEVIATIONS = 0.5, 1.645


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, urls whose path starts with ``path``."""

    host: str
    path: str
    allow: bool


RULES = (Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True), Rule("net", "/es/", False), Rule("net", "/fr/", False))


@dataclass(frozen=True)
class Priors:
    """The share of bad pages over all, and the strength in pages with which each level is drawn to the one above."""

    mean: float
    suffix: float
    site: float
    host: float


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty without ``://`` or for a null."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for a null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_name(host: Column) -> Column:
    """``host`` without user, port and trailing dots."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")


def _tails(name: Column, depth: int) -> Column:
    """The last 1, 2, ... ``depth`` labels of a name, as far as it has so many."""
    return F.array_distinct(F.array(*[F.substring_index(name, ".", -n) for n in range(1, depth + 1)]))


def sited(hosts: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """Rows by ``host`` with ``suffix`` (the longest of ``suffixes`` that ends the name, else the last label) and ``site``, one label more.

    An address in numbers or brackets is its own site, under an empty suffix.
    """
    name = host_name(F.col("host"))
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    known = F.substring_index(name, ".", -1)
    if suffixes:
        found = F.filter(_tails(name, max(s.count(".") + 1 for s in suffixes)), lambda t: t.isin(list(suffixes)))
        known = F.coalesce(F.try_element_at(found, F.lit(-1)), known)
    suffix = F.when(number, "").otherwise(known)
    before = F.expr("left(_name, greatest(length(_name) - length(suffix) - 1, 0))")
    site = F.when(number | (F.col("_name") == F.col("suffix")), F.col("_name")).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), "suffix"))
    return hosts.withColumns({"_name": name, "suffix": suffix}).withColumn("site", site).drop("_name")


def counted(seen: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """A row for each host of ``seen`` (page_id, host): its site and suffix, ``n`` labelled pages and ``bad`` ones among them.

    ``outcomes`` has a row for each labelled page: page_id, bad (boolean). Pages
    are counted by id and host before they meet their outcomes.
    """
    pages = seen.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("_pages"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("_bad"))
    met = pages.join(known, "page_id", "left")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("_pages"))), F.lit(0)).alias
    return sited(met.groupBy("host").agg(count(F.col("_bad").isNotNull())("n"), count(F.col("_bad"))("bad")), suffixes)


def _above(hosts: DataFrame, level: str) -> DataFrame:
    return hosts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("pairs").alias("below"), F.sum("bad_pairs").alias("bad_below"))


def _with_pairs(groups: DataFrame) -> DataFrame:
    """Ordered pairs of different pages of a group, and of bad ones; ``new``: those of them that no group below holds, over the group's pages."""
    pairs = lambda n: F.col(n).cast("double") * (F.col(n).cast("double") - 1)
    new = lambda all_, below: F.floor((F.col(all_) - F.col(below)) * PAIR_UNITS / F.greatest(F.col("n"), F.lit(1)).cast("double"))
    return groups.withColumns({"pairs": pairs("n"), "bad_pairs": pairs("bad")}).withColumns({"new": new("pairs", "below"), "bad_new": new("bad_pairs", "bad_below")})


def fit(hosts: DataFrame) -> tuple[Priors, DataFrame, DataFrame]:
    """Priors of the nested model for ``counted`` hosts, and the sites and suffixes with their counts.

    Two pages of one group are both bad with a probability that exceeds the one
    of pages that share only the group above by the variance of shares within
    that group. Pairs weigh one over their group's pages, so a large group counts
    as its pages do, not as their square. Without pairs to tell, or without
    variance, a level is as close to the one above as ``STRONGEST`` allows.
    """
    hosts = _with_pairs(hosts.withColumns({"below": F.lit(0.0), "bad_below": F.lit(0.0)}))
    sites = _with_pairs(_above(hosts, "site").join(hosts.groupBy("site").agg(F.max("suffix").alias("suffix")), "site"))
    suffixes = _with_pairs(_above(sites, "suffix"))
    sums = lambda df: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "bad", "new", "bad_new")]).first()
    top, middle, low = sums(suffixes), sums(sites), sums(hosts)
    mean = (top["bad"] + 1.0) / (top["n"] + 2.0)
    together, strength = [mean * mean], []
    for level in (top, middle, low):
        both = level["bad_new"] / level["new"] if level["new"] else together[-1]
        together.append(min(max(both, together[-1]), mean))
        gained, left = together[-1] - together[-2], mean - together[-2]
        strength.append(min(max(left / gained - 1.0, WEAKEST), STRONGEST) if gained > 0 else STRONGEST)
    return Priors(mean, *strength), sites.select("site", "suffix", "n", "bad"), suffixes.select("suffix", "n", "bad")


def reputation(hosts: DataFrame, *, deviations: float = DEVIATIONS) -> DataFrame:
    """Each host of ``counted`` (site, suffix, n, bad) with ``bad_share``, its posterior mean, and ``bound``, ``deviations`` standard deviations below (0 at least)."""
    priors, sites, suffixes = fit(hosts)
    shrunk = lambda mean, strength: (mean * strength + F.col("bad")) / (F.col("n") + F.lit(strength))
    suffixes = suffixes.select("suffix", shrunk(F.lit(priors.mean), priors.suffix).alias("_above"))
    sites = salted_join(sites, suffixes, "suffix", "site").select("site", shrunk(F.col("_above"), priors.site).alias("_above"))
    out = salted_join(hosts, sites, "site", "host").withColumn("bad_share", shrunk(F.col("_above"), priors.host)).drop("_above")
    spread = F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / (F.col("n") + F.lit(priors.host) + 1))
    return out.withColumn("bound", F.greatest(F.col("bad_share") - F.lit(deviations) * spread, F.lit(0.0)))


def ruled(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``hosts`` with ``_rules``: path, text and verdict of the rules for the host or a domain above it, longest text first; empty if there are none."""
    if not rules:
        return hosts.withColumn("_rules", F.array().cast("array<struct<rule:string,path:string,verdict:string>>"))
    spark = hosts.sparkSession
    rows = spark.createDataFrame([(r.host, r.host + r.path, r.path, "allow" if r.allow else "block") for r in rules], "_tail string, rule string, path string, verdict string").dropDuplicates(["rule"])
    depth = max(r.host.count(".") + 1 for r in rules)
    met = hosts.select("host", F.explode(_tails(F.col("host"), depth)).alias("_tail")).join(rows, "_tail")
    sort = F.struct((-F.length("rule")).alias("o"), "rule", "path", "verdict")
    fitting = met.groupBy("host").agg(F.sort_array(F.collect_set(sort)).alias("_r"))  # a host has no more than all rules
    fitting = fitting.select("host", F.transform("_r", lambda r: F.struct(r["rule"].alias("rule"), r["path"].alias("path"), r["verdict"].alias("verdict"))).alias("_rules"))
    return hosts.join(fitting, "host", "left").withColumn("_rules", F.coalesce("_rules", F.array().cast("array<struct<rule:string,path:string,verdict:string>>")))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] = (), limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """Every page with host, path, rule, verdict and what the reputation says of its host: labelled, labelled_bad, bad_share, bound.

    ``rule`` is the longest rule (host and path as one text) that fits, null if
    none does; its verdict holds, else ``block`` if the host's bound exceeds
    ``limit``. A url that is null or has no ``://`` has an empty host, which has a
    reputation as any other. Of two equal rules the last one given counts. Repeated pages count each; a
    page without an id has no outcome. Without outcomes all shares are one half.
    Columns of ``pages`` named as those above are replaced; others pass through.
    """
    rules = list({r.host + r.path: r for r in rules}.values())
    host, path = fresh_names(pages, "_host", "_path")
    parsed = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    hosts = checkpointed(counted(parsed.select(F.col(id_col).alias("page_id"), F.col(host).alias("host")), outcomes, suffixes))
    known = ruled(reputation(hosts, deviations=deviations), rules)
    (state,) = fresh_names(parsed, "_state")
    known = known.select(F.col("host").alias(host), F.struct("_rules", "n", "bad", "bad_share", "bound").alias(state))
    out = salted_join(parsed, known, host, F.struct(id_col, path))
    fits = F.filter(F.col(f"{state}._rules"), lambda r: F.col(path).startswith(r["path"]))
    first = F.try_element_at(fits, F.lit(1))
    verdict = F.coalesce(first["verdict"], F.when(F.col(f"{state}.bound") > limit, "block").otherwise("allow"))
    new = {"host": F.col(host), "path": F.col(path), "rule": first["rule"], "verdict": verdict, "labelled": F.col(f"{state}.n"), "labelled_bad": F.col(f"{state}.bad"), "bad_share": F.col(f"{state}.bad_share"), "bound": F.col(f"{state}.bound")}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    return out.select(*kept, *[c.alias(n) for n, c in new.items()])


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labelled pages by the id they share with ``labels``: bad if of low quality or toxic; a row with neither label says nothing."""
    said = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.where(said).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, outcomes_of(table(spark, sf_dir, "labels"))).drop("url")


#: The same with windows and list functions.
OP13_SQL = """
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), outcomes AS (
  SELECT doc_id AS page_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1
), named AS (
  SELECT host, regexp_replace(host, '^.*@|:[0-9]*$|\\.+$', '', 'g') AS name, CAST(count(o.bad) AS BIGINT) AS n, CAST(count(*) FILTER (o.bad) AS BIGINT) AS bad
  FROM parsed p LEFT JOIN outcomes o USING (page_id) GROUP BY 1, 2
), hosts AS (
  SELECT host, n, bad,
         CASE WHEN regexp_matches(name, '^[0-9]+(\\.[0-9]+){3}$') OR starts_with(name, '[') THEN '' ELSE split_part(name, '.', -1) END AS suffix,
         CASE WHEN regexp_matches(name, '^[0-9]+(\\.[0-9]+){3}$') OR starts_with(name, '[') THEN name ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS site
  FROM named
), sites AS (
  SELECT site, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, sum(n * (n - 1))::BIGINT AS below, sum(bad * (bad - 1))::BIGINT AS bad_below FROM hosts GROUP BY 1, 2
), suffixes AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, sum(n * (n - 1))::BIGINT AS below, sum(bad * (bad - 1))::BIGINT AS bad_below FROM sites GROUP BY 1
), levels AS (
  SELECT 1 AS level, n, bad, floor((n * (n - 1) - below)::DOUBLE * 1048576 / greatest(n, 1)) AS new, floor((bad * (bad - 1) - bad_below)::DOUBLE * 1048576 / greatest(n, 1)) AS bad_new FROM suffixes
  UNION ALL
  SELECT 2, n, bad, floor((n * (n - 1) - below)::DOUBLE * 1048576 / greatest(n, 1)), floor((bad * (bad - 1) - bad_below)::DOUBLE * 1048576 / greatest(n, 1)) FROM sites
  UNION ALL
  SELECT 3, n, bad, floor((n * (n - 1))::DOUBLE * 1048576 / greatest(n, 1)), floor((bad * (bad - 1))::DOUBLE * 1048576 / greatest(n, 1)) FROM hosts
), sums AS (
  SELECT (coalesce(sum(bad) FILTER (level = 1), 0) + 1.0::DOUBLE) / (coalesce(sum(n) FILTER (level = 1), 0) + 2.0::DOUBLE) AS mean,
         CASE WHEN sum(new) FILTER (level = 1) > 0 THEN sum(bad_new) FILTER (level = 1) / sum(new) FILTER (level = 1) END AS p1,
         CASE WHEN sum(new) FILTER (level = 2) > 0 THEN sum(bad_new) FILTER (level = 2) / sum(new) FILTER (level = 2) END AS p2,
         CASE WHEN sum(new) FILTER (level = 3) > 0 THEN sum(bad_new) FILTER (level = 3) / sum(new) FILTER (level = 3) END AS p3
  FROM levels
), t0 AS (SELECT *, mean * mean AS q0 FROM sums
), t1 AS (SELECT *, least(greatest(coalesce(p1, q0), q0), mean) AS q1 FROM t0
), t2 AS (SELECT *, least(greatest(coalesce(p2, q1), q1), mean) AS q2 FROM t1
), t3 AS (SELECT *, least(greatest(coalesce(p3, q2), q2), mean) AS q3 FROM t2
), priors AS (
  SELECT mean, CASE WHEN q1 > q0 THEN least(greatest((mean - q0) / (q1 - q0) - 1, 0.5), 1000) ELSE 1000 END::DOUBLE AS s1,
         CASE WHEN q2 > q1 THEN least(greatest((mean - q1) / (q2 - q1) - 1, 0.5), 1000) ELSE 1000 END::DOUBLE AS s2,
         CASE WHEN q3 > q2 THEN least(greatest((mean - q2) / (q3 - q2) - 1, 0.5), 1000) ELSE 1000 END::DOUBLE AS s3
  FROM t3
), suffix_means AS (SELECT suffix, (mean * s1 + bad) / (n + s1) AS m FROM suffixes, priors
), site_means AS (SELECT site, (m * s2 + bad) / (n + s2) AS m FROM sites JOIN suffix_means USING (suffix), priors
), means AS (SELECT host, h.n, h.bad, (m * s3 + h.bad) / (h.n + s3) AS bad_share, s3 FROM hosts h JOIN site_means USING (site), priors
), known AS (SELECT *, greatest(bad_share - 1.645::DOUBLE * sqrt(bad_share * (1 - bad_share) / (n + s3 + 1)), 0.0::DOUBLE) AS bound FROM means
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT host, path, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict), length(rule_host || rule_path)) AS best
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY 1, 2
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       n AS labelled, bad AS labelled_bad, bad_share, bound
FROM parsed JOIN known USING (host) LEFT JOIN fits USING (host, path)
"""
