"""URL filters: rules by host and path, and where none fits, trust and distrust that spread over links between hosts.

* ``ruled``: a rule (host, path, verdict) fits its host and all subdomains where the url's path starts with its own; the longest
  rule (host and path) wins, of equally long ones the first in order of text. Rules are a table: a url meets
  them by equal host suffix and equal path prefix, of such lengths only as the suffix has rules for.
* ``links``: arcs between hosts, from the hrefs of pages outside comments, scripts and styles.
* ``spread``: personalised PageRank. Hosts with pages that rules allow are trusted seeds, those with blocked pages
  distrusted ones, each by the share of its ruled pages. Trust follows links, distrust goes against them. What reaches a host in a
  round is passed on, damped, in proportion to its links, until a round brings nothing or ROUNDS have passed; the
  sums of all rounds are the ranks (what hosts without links hold isn't dealt out again). Masses are whole
  numbers, rounded down, so that the order of rows has no effect.
* A host is blocked if its distrust is over THRESHOLD of the sum of both; one that neither reaches is allowed.

A null url, or one without ``://``, has empty host and path: no rule fits, and it is allowed. Pages that repeat are rows of their own.
A null html has no links. Empty tables give no rows. Other columns than page_id, url, html aren't read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.session import materialize

#: The rules of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DAMPING, ROUNDS, THRESHOLD, UNITS = 0.85, 20, 0.5, 1_000_000_000
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
HREF, LINKED = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)""", r"(?i)^(?:https?:)?//([^/?#]*)"


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every page."""
    part = lambda pattern: F.coalesce(F.regexp_extract("url", pattern, 1), F.lit(""))
    return pages.select("page_id", _lower(part(HOST)).alias("host"), part(PATH).alias("path"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct urls that a rule fits."""
    lengths = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("sizes"))  # as many as a path has characters
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    open_to = hosts.join(lengths, "suffix").select("host", "suffix", F.explode("sizes").alias("size"))
    tried = urls.join(open_to, "host").where(F.length("path") >= F.col("size")).withColumn("prefix", F.left("path", F.col("size")))
    fits = tried.join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict"), ["suffix", "prefix"])
    name = F.concat("suffix", "prefix")
    best = F.min(F.struct((-F.length(name)).alias("short"), name.alias("rule"), "verdict")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another, counted."""
    seen = F.regexp_replace("html", UNSEEN, " ")
    rows = pages.select(F.coalesce(_lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(seen, F.lit(HREF), F.lit(1)))).alias("href"))
    rows = rows.select("src", _lower(F.regexp_extract("href", LINKED, 1)).alias("dst"))
    return rows.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(arcs: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of the hosts that seeds (run, host, mass) reach; runs are trust, along the arcs, and distrust, against them."""
    both = arcs.select(F.lit("trust").alias("run"), "src", "dst", "n").unionAll(arcs.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    out = both.groupBy("run", "src").agg(F.sum("n").alias("all"))
    shares = materialize(both.join(out, ["run", "src"]).select("run", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    here = materialize(seeds.select("run", "host", F.col("mass").cast("long").alias("mass")), "mass")
    every = here
    for _ in range(rounds):
        sent = here.join(shares, ["run", "host"]).select("run", F.col("dst").alias("host"), F.floor(F.col("mass") * F.col("share") * damping).cast("long").alias("mass"))
        here = materialize(sent.groupBy("run", "host").agg(F.sum("mass").alias("mass")).where("mass > 0"), "mass")
        if here.isEmpty():
            break
        every = every.unionByName(here)
    run = lambda name: F.coalesce(F.sum(F.when(F.col("run") == name, F.col("mass"))), F.lit(0)).alias(name)
    return every.groupBy("host").agg(run("trust"), run("distrust"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    rows = parsed(pages)
    urls = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("pages")), "urls")
    hits = materialize(urls.join(ruled(urls.select("host", "path"), rules), ["host", "path"], "left"), "ruled")
    of = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("pages")).otherwise(0))
    tally = hits.where("verdict IS NOT NULL").groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    seeds = tally.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("run", "n"), (F.col("trust") + F.col("distrust")).alias("all"))
    ranks = spread(links(pages), seeds.where("n > 0").select("run", "host", F.floor(UNITS * F.col("n") / F.col("all")).alias("mass")))
    blocked = F.coalesce(F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust")), F.lit(False))
    judged = hits.join(ranks, "host", "left").select("host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("trust", "distrust")])


def url_filter(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


def _oracle() -> str:
    low = lambda text: f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"
    q = lambda text: "'" + text.replace("'", "''") + "'"
    rules = ", ".join(f"({q(h)}, {q(p)}, {q(v)})" for h, p, v in RULES)
    steps = "".join(f", m{k} AS MATERIALIZED (SELECT run, dst AS host, sum(mass) AS mass FROM (SELECT m.run, s.dst, CAST(floor(mass * share * CAST({DAMPING} AS DOUBLE)) AS BIGINT) AS mass FROM m{k - 1} m JOIN shares s ON s.run = m.run AND s.host = m.host) q GROUP BY run, dst HAVING sum(mass) > 0)" for k in range(1, ROUNDS + 1))
    every = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(ROUNDS + 1))
    return f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {rules}),
rows_ AS (SELECT row_number() OVER () AS r, page_id, coalesce({low(f"regexp_extract(url, {q(HOST)}, 1)")}, '') AS host, coalesce(regexp_extract(url, {q(PATH)}, 1), '') AS path, html FROM pages),
fits AS (SELECT r, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS place FROM rows_ JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
hits AS (SELECT rows_.r, page_id, host, path, html, rule, verdict FROM rows_ LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON f.r = rows_.r),
refs AS (SELECT host AS src, {low(f"regexp_extract(unnest(list_distinct(regexp_extract_all(regexp_replace(html, {q(UNSEEN)}, ' ', 'g'), {q(HREF)}, 1))), {q(LINKED)}, 1)")} AS dst FROM hits WHERE html IS NOT NULL),
arcs AS (SELECT src, dst, count(*) AS n FROM refs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
ways AS (SELECT 'trust' AS run, src AS host, dst, n FROM arcs UNION ALL SELECT 'distrust', dst, src, n FROM arcs),
shares AS (SELECT run, host, dst, n / CAST(sum(n) OVER (PARTITION BY run, host) AS DOUBLE) AS share FROM ways),
tally AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS trust, count(*) FILTER (WHERE verdict = 'block') AS distrust FROM hits WHERE verdict IS NOT NULL GROUP BY host),
m0 AS (SELECT run, host, CAST(floor({UNITS} * n / CAST(every AS DOUBLE)) AS BIGINT) AS mass FROM (SELECT host, 'trust' AS run, trust AS n, trust + distrust AS every FROM tally UNION ALL SELECT host, 'distrust', distrust, trust + distrust FROM tally) q WHERE n > 0){steps},
ranks AS (SELECT host, CAST(coalesce(sum(mass) FILTER (WHERE run = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (WHERE run = 'distrust'), 0) AS BIGINT) AS distrust FROM ({every}) e GROUP BY host)
SELECT page_id, hits.host, path, rule, coalesce(verdict, CASE WHEN distrust > CAST({THRESHOLD} AS DOUBLE) * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM hits LEFT JOIN ranks ON ranks.host = hits.host"""


ORACLE_SQL = _oracle()
