import math
from collections import defaultdict
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from earshot.llm import urls
from earshot.llm.urls import Rule

PAGES = "page_id long, url string, html string, host int"
OUTCOMES = "page_id long, bad boolean"


def judged(spark, pages, outcomes=(), **how):
    frame = spark.createDataFrame([(i, u, "h", 1) for i, u in pages], PAGES).repartition(2)
    return urls.judged(frame, spark.createDataFrame(list(outcomes), OUTCOMES), **how)


def rows(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


URLS = [
    ("http://A.Example.COM/En/x?q=1#f", "a.example.com", "/En/x"),
    ("https://x.org", "x.org", ""),
    ("https://x.org?q=/a", "x.org", ""),
    ("x://h#/a", "h", ""),
    ("no scheme/a", "", ""),
    ("a://b://c/d", "b:", "//c/d"),
    ("://", "", ""),
    ("http:///p", "", "/p"),
    ("http://ÄB.de/\n\tq", "Äb.de", "/\n\tq"),
    (None, "", ""),
    ("", "", ""),
    ("http://user@H:80/" + "x" * 100_000, "user@h:80", "/" + "x" * 100_000),
]


def test_parts_of_urls(spark):
    got = {r.page_id: (r.host, r.path) for r in judged(spark, [(i, u) for i, (u, _, _) in enumerate(URLS)]).collect()}
    assert got == {i: (host, path) for i, (_, host, path) in enumerate(URLS)}


def test_hosts_agree_with_the_standard_library(spark):
    pages = [(i, f"http://{h}{p}") for i, (h, p) in enumerate([("a.b", "/c?d#e"), ("a.b", "?d/e"), ("a.b", "#d?e/"), ("a.b", "/c#d?e")])]
    assert rows(judged(spark, pages), "page_id", "host", "path") == sorted((i, urlsplit(u).netloc, urlsplit(u).path) for i, u in pages)


RULED = [
    ("http://a.com/x", "com/", "allow"),
    ("http://com/x", "com/", "allow"),
    ("http://acom/x", None, "allow"),
    ("http://a.com", None, "allow"),  # an empty path starts with no rule's
    ("http://example.com/en/x", "example.com/en/", "block"),
    ("http://example.com/en", "com/", "allow"),
    ("http://m.example.com/en/", "example.com/en/", "block"),
    ("http://www.example.com/en/x", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/x", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/x", "com/", "allow"),
    ("http://a.net/es/", "net/es/", "block"),
    ("http://a.net/fr/?x", "net/fr/", "block"),
    ("http://a.net/de/", None, "allow"),
]


def test_longest_rule_wins(spark):
    got = {r.page_id: (r.rule, r.verdict) for r in judged(spark, [(i, u) for i, (u, _, _) in enumerate(RULED)]).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(RULED)}


def test_of_two_equal_rules_the_last_counts_and_none_are_needed(spark):
    assert rows(judged(spark, [(1, "x://a/b")], rules=[Rule("a", "/", True), Rule("a", "/", False)]), "verdict") == [("block",)]
    assert rows(judged(spark, [(1, "x://a/b")], rules=[]), "rule", "verdict") == [(None, "allow")]


SITES = [("a.b.example.org", "example.org", "org"), ("example.org.", "example.org", "org"), ("u@example.org:80", "example.org", "org"), ("org", "org", "org"), ("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1", ""), ("[::1]:80", "[::1]", ""), ("", "", "")]


def test_sites(spark):
    got = urls.sited(spark.createDataFrame([(h,) for h, _, _ in SITES], "host string"), suffixes=("co.uk", "uk"))
    assert rows(got, "host", "site", "suffix") == sorted(SITES, key=str)


def shares(pages, outcomes):
    """The model in plain Python, over pages one by one."""
    bad = {}
    for i, b in outcomes:
        if i is not None and b is not None:
            bad[i] = bad.get(i, False) or b
    known = [(u.split("/")[2], bad[i]) for i, u in pages if i in bad]
    level = {"host": lambda h: h, "site": lambda h: ".".join(h.split(".")[-2:]), "suffix": lambda h: h.split(".")[-1]}
    counts = {name: defaultdict(lambda: [0, 0]) for name in level}
    for h, b in known:
        for name, key in level.items():
            counts[name][key(h)][0] += 1
            counts[name][key(h)][1] += b
    mean = (sum(b for _, b in known) + 1) / (len(known) + 2)
    together, strength = [mean**2], {}
    for name, below in (("suffix", "site"), ("site", "host"), ("host", None)):
        new, both = 0.0, 0.0
        for g, (n, b) in counts[name].items():
            inner = [counts[below][k] for k in counts[below] if level[name](k) == g] if below else []
            new += math.floor((n * (n - 1) - sum(x * (x - 1) for x, _ in inner)) * 2**20 / n)
            both += math.floor((b * (b - 1) - sum(y * (y - 1) for _, y in inner)) * 2**20 / n)
        together.append(min(max(both / new if new else together[-1], together[-1]), mean))
        gained = together[-1] - together[-2]
        strength[name] = min(max((mean - together[-2]) / gained - 1, 0.5), 1000) if gained > 0 else 1000

    def share(host):
        m = mean
        for name in ("suffix", "site", "host"):
            n, b = counts[name].get(level[name](host), (0, 0))
            m = (m * strength[name] + b) / (n + strength[name])
        n = counts["host"].get(host, (0, 0))[0]
        return m, max(m - 1.645 * math.sqrt(m * (1 - m) / (n + strength["host"] + 1)), 0)

    return share


def test_shares_by_brute_force(spark):
    sites = [f"s{k}.{s}" for k in range(6) for s in ("org", "net")]
    pages = [(i, f"http://h{i % 3}.{sites[i * i % 12]}/p") for i in range(600)]
    outcomes = [(i, (i * 7919) % 100 < (80 if "s1.org" in pages[i][1] else 60 if "h1" in pages[i][1] else 10)) for i in range(0, 600, 2)]
    outcomes += [(0, True), (0, None), (None, True)]
    share = shares(pages, outcomes)
    got = judged(spark, pages, outcomes, rules=[]).select("host", "bad_share", "bound", "verdict").distinct().collect()
    for host, mean, bound, verdict in got:
        assert (mean, bound) == pytest.approx(share(host), rel=1e-9)
        assert verdict == ("block" if share(host)[1] > 0.5 else "allow")
    assert {r.verdict for r in got} == {"block", "allow"}


def test_a_bad_host_is_blocked_and_lends_its_name_to_its_site(spark):
    pages = [(i, f"http://{'www' if i % 20 < 10 else 'm'}.{'spam' if i % 10 == 0 else f'good{i % 7}'}.org/{i}") for i in range(1000)] + [(5000, "http://new.spam.org/"), (5001, "http://new.good1.org/"), (5002, "http://once.org/")]
    outcomes = [(i, i % 10 == 0 or i % 31 == 0) for i in range(1000)] + [(5002, True)]
    got = {r.page_id: r for r in judged(spark, pages, outcomes, rules=[]).collect()}
    assert {r.verdict for i, r in got.items() if i < 1000 and i % 10 == 0} == {"block"}
    assert {r.verdict for i, r in got.items() if i < 1000 and i % 10} == {"allow"}
    assert got[5000].bad_share > 3 * got[5001].bad_share
    assert got[5001].bad_share < got[5002].bad_share < got[0].bad_share


def test_rules_come_before_the_reputation(spark):
    pages = [(i, f"http://{'a' if i % 2 else 'b'}.org/x") for i in range(200)]
    got = judged(spark, pages, [(i, i % 2 == 1) for i in range(200)], rules=[Rule("a.org", "/", True)])
    assert rows(got.groupBy("host", "verdict").count(), "host", "verdict") == [("a.org", "allow"), ("b.org", "allow")]


def test_hot_hosts_and_odd_rows(spark, monkeypatch):
    from earshot.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8)
    pages = [(i, "http://hot.org/a") for i in range(60)] + [(None, "http://hot.org/a"), (None, None), (7, None), (7, "http://x.org/"), (7, "http://x.org/")]
    got = judged(spark, pages, [(7, True), (7, False)])
    assert rows(got, "page_id", "host") == sorted([(i, u.split("/")[2] if u else "") for i, u in pages], key=str)
    assert {(r.host, r.labelled, r.labelled_bad) for r in got.collect()} == {("hot.org", 1, 1), ("", 1, 1), ("x.org", 2, 2)}
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict", "labelled", "labelled_bad", "bad_share", "bound"]


def test_no_pages_and_no_outcomes(spark):
    assert judged(spark, []).count() == 0
    assert rows(judged(spark, [(1, "x://a/b")]), "labelled", "bad_share", "verdict") == [(0, 0.5, "allow")]


def test_outcomes_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (5, None, 1), (6, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = urls.outcomes_of(labels).where(F.col("page_id").isNotNull())
    assert rows(got, "page_id", "bad") == [(1, False), (2, True), (3, True), (5, True), (6, False)]
