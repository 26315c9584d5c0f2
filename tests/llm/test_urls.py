"""URL rules against a loop over them, and the spread of trust against a plain one."""

import math
import re

import pytest
from pyspark.sql import functions as F

from claimweave.llm import urls

RULES = urls.RULES + [("a.net", "", "block"), ("a.net", "/x", "allow"), ("net", "/long/path/here", "block")]
URLS = [
    "http://ThThre.Example.COM/fr/825?page=2", "https://x.example.org/es/1", "https://example.org/en/17#top", "http://b.org", "http://b.org?x=/fr/", "http://org/a", "http://notorg/a",
    "http://com.evil.net/fr/", "http://evil-example.org/es/", "no scheme/fr/", "", None, "://", "http://q.com/DE/", "http://q.com/de/#/fr/", "see http://u.com/fr/://v.org/", "http://a.net", "http://s.a.net/xy",
    "http://deep.sub.a.net/long/path/here/z", "http://É.com/fr/ü", "http://u.com:80/fr/", "HTTP://k.com/fr/" + "a" * 50_000, "http://line\nbreak.com/de/\nx",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[1:] if fits else (None, None)


@pytest.mark.parametrize("rules", [urls.RULES, RULES])
def test_rules(spark, rules):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS * 2)], "page_id long, url string, html string").withColumns({c: F.lit("?") for c in ("host", "path", "rule", "verdict", "suffix", "n", "mass", "run")})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = {r["page_id"]: r for r in urls.judge(pages, table).collect()}
    assert len(rows) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        host, path = split(u)
        rule, verdict = rule_of(host, path, rules)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule), u
        assert verdict is None or rows[i]["verdict"] == verdict


def plain_spread(arcs, seeds):
    """Rounds of dense sums, in whole units."""
    out = {"trust": {}, "distrust": {}}
    for run, total in out.items():
        ways = [(a, b, n) if run == "trust" else (b, a, n) for (a, b), n in arcs.items()]
        leaving = {}
        for a, _, n in ways:
            leaving[a] = leaving.get(a, 0) + n
        here = {h: m for (r, h), m in seeds.items() if r == run}
        for _ in range(urls.ROUNDS + 1):
            for h, m in here.items():
                total[h] = total.get(h, 0) + m
            new = {}
            for a, b, n in ways:
                if m := math.floor(here.get(a, 0) * (n / leaving[a]) * urls.DAMPING):
                    new[b] = new.get(b, 0) + m
            here = new
    return out


def test_links_and_spread(spark):
    """A hub, a loop, a chain to a blocked host, links inside comments and scripts, and relative ones."""
    a = lambda *hosts: "".join(f'<p><A class=x HREF = "{h}">t</a>' for h in hosts)
    pages = [(0, "http://good.com/fr/1", a("http://Mid.net/x", "//far.net/", "/fr/2", "mailto:x@y.net"))] + [(10 + i, f"http://good.com/fr/{i}", a("http://mid.net/x")) for i in range(5)]
    pages += [(1, "http://mid.net/", a("http://far.net/", "http://good.com/", "http://mid.net/self")), (2, "http://far.net/p", a("http://end.net/")), (3, "http://end.net/q", None)]
    pages += [(4, "http://farm.net/1", a("http://bad.com/de/", "http://farm2.net/")), (5, "http://farm2.net/1", a("http://farm.net/", "http://bad.com/")), (6, "http://bad.com/de/1", a("http://farm.net/", "http://lone.net/"))]
    pages += [(7, "http://lone.net/1", "<!-- " + a("http://bad.com/") + " --><script>" + a("http://bad.com/") + "</script >" + a("http://good.com/?a=1&b"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    arcs = {(r["src"], r["dst"]): r["n"] for r in urls.links(df).collect()}
    assert arcs == {
        ("good.com", "mid.net"): 6, ("good.com", "far.net"): 1, ("mid.net", "far.net"): 1, ("mid.net", "good.com"): 1, ("far.net", "end.net"): 1, ("farm.net", "bad.com"): 1, ("farm.net", "farm2.net"): 1,
        ("farm2.net", "farm.net"): 1, ("farm2.net", "bad.com"): 1, ("bad.com", "farm.net"): 1, ("bad.com", "lone.net"): 1, ("lone.net", "good.com"): 1,
    }
    want = plain_spread(arcs, {("trust", "good.com"): urls.UNITS, ("distrust", "bad.com"): urls.UNITS})
    rows = {r["page_id"]: r for r in urls.url_filter(spark, df).collect()}
    for i, url, _ in pages:
        host = split(url)[0]
        assert (rows[i]["trust"], rows[i]["distrust"]) == (want["trust"].get(host, 0), want["distrust"].get(host, 0))
    assert [rows[i]["verdict"] for i in (0, 1, 2, 3, 4, 5, 6, 7)] == ["allow", "allow", "allow", "allow", "block", "block", "block", "allow"]


def test_mixed_seed_and_empty(spark):
    df = spark.createDataFrame([(1, "http://m.com/fr/1", ""), (2, "http://m.com/de/1", ""), (3, "http://m.com/de/2", ""), (4, "http://m.com/en/", "")], "page_id long, url string, html string")
    rows = {r["page_id"]: (r["verdict"], r["trust"], r["distrust"]) for r in urls.url_filter(spark, df).collect()}
    third = urls.UNITS // 3
    assert rows[4] == ("block", third, 2 * third) and rows[1][0] == "allow"
    assert urls.url_filter(spark, df.limit(0)).count() == 0
