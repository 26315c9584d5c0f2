"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (sha256 of the text). The ledger holds a row for
each blob and rule version scanned so far. A scan works on the pairs the ledger lacks, on one copy
of each blob, and findings are joined back to all paths that hold the blob.

Null texts count as empty; rows that repeat give rows that repeat; a path may hold many versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,rank:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0


#: Runs are maximal, so the least length of access and hex can stand in the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _found(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of a rule in code points: what lies between matches gives where they start."""
    none = F.array().cast(SPAN)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matched = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    zipped = F.arrays_zip(between.alias("gap"), F.transform(matched, F.length).alias("size"), kept.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.lit(rank).alias("rank"))
        more = x["size"].isNotNull() & (x["kept"] >= rule.least)
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(more, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN).alias("out"))

    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), folded).otherwise(none)


def blobs(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's new rows: (blob, spans) with a span list for each unseen rule version in ``done``.

    ``ledger`` has (blob, kind, version) of earlier scans; pairs found there aren't scanned again.
    A blob's text is read at its least path only; that join is on the path, which no group of
    copies can make hot."""
    seen = blobs(versions, path_col, text_col)
    place = F.coalesce(F.col("path").cast("string"), F.lit(""))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    first = seen.groupBy("blob").agg(F.min(place).alias("place"))
    if ledger is None:
        todo = first.withColumn("kinds", F.lit([r.kind for r in rules]))
    else:
        pairs = first.withColumn("pair", F.explode(wanted)).select("blob", "place", "pair.kind", "pair.version")
        todo = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti").groupBy("blob", "place").agg(F.collect_set("kind").alias("kinds"))
    texts = seen.withColumn("place", place).drop("path").join(todo, ["place", "blob"])
    spans = [F.when(F.array_contains("kinds", r.kind), _found(r, i, F.col("text"))).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
    found = texts.select("blob", "kinds", F.array_sort(F.concat(*spans)).alias("spans"))
    return found.groupBy("blob").agg(F.first("kinds").alias("kinds"), F.first("spans").alias("spans"))  # a path may repeat a blob


def ledger_rows(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What to append to the ledger: (blob, kind, version, spans)."""
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    rows = scanned.select("blob", "spans", F.explode("kinds").alias("kind"))
    return rows.select("blob", "kind", version[F.col("kind")].alias("version"), F.filter("spans", lambda s: s["rank"] == rank[F.col("kind")]).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, spans) of the blobs of ``versions`` that hold any secret: unseen pairs are scanned, the others' spans come from the ledger.

    ``ledger`` has rows of ledger_rows(), from scans with any rules; those of other rule versions don't count."""
    new = scan(versions, ledger, rules, path_col, text_col).select("blob", "spans")
    if ledger is None:
        return new.where(F.size("spans") > 0)
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.concat_ws("\0", F.lit(r.kind), F.lit(r.version)), F.lit(i))])
    known = ledger.select("blob", "spans", rank[F.concat_ws("\0", "kind", "version")].alias("own")).where("own IS NOT NULL AND size(spans) > 0")
    known = known.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.col("own").alias("rank"))).alias("spans"))
    here = blobs(versions, path_col, text_col).select("blob").distinct()
    both = known.join(here, "blob", "left_semi").unionByName(new.where(F.size("spans") > 0))
    return both.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))  # a row for each rule at most


def secrets_by_document(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """A row for each document: counts by base kind, the digest of base spans, and all spans, ordered by start, then kind."""
    scanned = findings(docs, ledger, rules)
    paths = blobs(docs, "doc_id", "text").select(F.col("path").alias("doc_id"), "blob")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    hits = scanned.select("blob", ordered.alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    of_rank = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    counts = [of_rank(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    hits = hits.select("blob", *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))
    zero = {f"n_{r.kind}": 0 for r in BASE} | {"spans": ""}
    return paths.join(hits, "blob", "left").drop("blob").fillna(zero).withColumn("base_sha256", F.coalesce("base_sha256", F.sha2(F.lit(""), 256)))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        p = quote(r.pattern)
        parts.append(
            f"SELECT t.doc_id, {i} AS rk, {quote(r.kind)} AS kind, m.at AS n, t.g[m.at] AS hit, t.k[m.at] AS kept, "
            f"list_sum(list_transform(t.b[1:m.at], lambda x: length(x))) + coalesce(list_sum(list_transform(t.g[1:m.at-1], lambda x: length(x))), 0) AS s "
            f"FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), {p}) AS b, regexp_extract_all(coalesce(text, ''), {p}, 0) AS g, regexp_extract_all(coalesce(text, ''), {p}, {r.group}) AS k "
            f"FROM documents WHERE regexp_matches(coalesce(text, ''), {p})) t, LATERAL (SELECT unnest(range(1, len(t.g) + 1)) AS at) m WHERE length(t.k[m.at]) >= {r.least}"
        )
    span = "kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s AS BIGINT) + length(hit) AS VARCHAR)"
    counts = ", ".join(f"CAST(coalesce(count(*) FILTER (WHERE f.rk = {i}), 0) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))
    return (
        "WITH f AS (" + " UNION ALL ".join(parts) + ") "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY s, rk) FILTER (WHERE f.rk < {len(BASE)}), '')) AS base_sha256, "
        f"coalesce(string_agg({span}, ',' ORDER BY s, rk), '') AS spans "
        "FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"
    )


ORACLE_SQL = _sql()
