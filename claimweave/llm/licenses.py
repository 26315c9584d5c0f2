"""License scans: sparse TF-IDF cosine to templates, and inheritance from directories; DataFrame functions only.

A line is a candidate if it has one of the ANCHORS. Its vector has, for each word, count times idf;
idf is log((1 + N) / (1 + df)) + 1 over all N texts, for the words of templates; words that no
template has weigh as if no text had them. A text gets the license of its best line, by
cosine with a template, if that reaches THRESHOLD. Ties: the name that sorts first, then the line.

A license file is one named so (FILE_NAME), or one whose candidate lines hold at least FILE_SHARE
of its words. It licenses its directory. Texts without a license of their own take that of the
nearest ancestor directory that has one: the best score there, then the path that sorts first.
The walk is done once for each directory, then joined to its texts.

With ``whole``, no line is left out for want of an anchor and every word is weighed by its number of
texts: candidates are the lines with a word of needed_words(), without which no line reaches
THRESHOLD. The registered SQL has the narrower form.

Null and empty texts have no license of their own, but can inherit. Null paths don't inherit. Rows
that repeat repeat. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize

BROADCAST_ROWS = 200_000
THRESHOLD, FILE_SHARE = 0.5, 0.25
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
#: Notices as they stand in headers and license files, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "Copyright. All rights reserved."),
)
#: A template has at least one of these.
ANCHORS = r"licen[sc]|permission|copyright|redistribution|public domain|unencumbered"
WORD = "[a-z0-9.]*[a-z0-9]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def templates(docs: DataFrame, total: int, df: DataFrame | None = None) -> DataFrame:
    """(template, license, term, idf, weight, norm) with idf over ``docs`` (path, text). A bounded table."""
    spark = docs.sparkSession
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    counts = rows.select("template", "license", F.explode(words(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    vocabulary = [r["term"] for r in counts.select("term").distinct().collect()]  # of the templates only
    has = F.filter(F.array_distinct(words(F.col("text"))), lambda w: w.isin(vocabulary))
    df = df.where(F.col("term").isin(vocabulary)) if df is not None else docs.select(F.explode(has).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = counts.join(F.broadcast(df), "term", "left")  # df has the templates' terms at most
    weighed = weighed.withColumn("idf", F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    return weighed.join(F.broadcast(norms), "template").select("template", "license", "term", "idf", (F.col("tf") * F.col("idf")).alias("weight"), "norm")


def own_licenses(docs: DataFrame) -> DataFrame:
    """(path, license, score, licensed_words) of the texts that have one, each path once."""
    lines = docs.select("path", F.explode(F.filter(F.split("text", "\n", -1), lambda x: F.lower(x).rlike(ANCHORS))).alias("line")).distinct()
    lines = lines.withColumn("n", F.size(words(F.col("line"))))
    terms = lines.select("path", "line", "n", F.explode(words(F.col("line"))).alias("term")).groupBy("path", "line", "n", "term").agg(F.count("*").alias("tf"))
    total = docs.count()
    known = F.broadcast(templates(docs, total))
    idf = F.broadcast(known.select("term", "idf").distinct())
    unknown = F.log(F.lit(1.0 + total)) + 1
    norms = terms.join(idf, "term", "left").groupBy("path", "line").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", unknown), 2))).alias("own"))
    return _best(terms, known, norms)


def _best(terms: DataFrame, known: DataFrame, norms: DataFrame) -> DataFrame:
    dots = terms.join(known, "term").groupBy("path", "line", "n", "template", "license", "norm").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["path", "line"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("own")), 6)).where(F.col("score") >= THRESHOLD)
    best = scored.groupBy("path", "line", "n").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("b"))
    return best.groupBy("path").agg(F.min(F.struct("b.low", "b.license")).alias("b"), F.sum("n").alias("licensed_words")).select("path", "b.license", (-F.col("b.low")).alias("score"), "licensed_words")


def needed_words(known: DataFrame) -> list[str]:
    """Words of which a line must have one to reach THRESHOLD with a template of ``known``.

    A cosine is at most the root of the share of the template's squared weights that the line's words
    hold. Of each template the lightest words go, as long as all that went hold too small a share."""
    rows, out = {}, set()
    for r in known.collect():  # of the templates only
        rows.setdefault(r["template"], []).append(((r["weight"] / r["norm"]) ** 2, r["term"]))
    for terms in rows.values():
        held = 0.0
        for share, term in sorted(terms):
            held += share
            if held >= (THRESHOLD - 1e-6) ** 2 - 1e-9:
                out.add(term)
    return sorted(out)


def own_licenses_whole(docs: DataFrame) -> DataFrame:
    """As own_licenses(), from all lines, with idf over all texts for every word."""
    total = docs.count()
    df = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = materialize(df, "df")
    known = materialize(templates(docs, total, df), "templates")
    needed = F.array(*[F.lit(w) for w in needed_words(known)])
    lines = docs.select("path", F.explode(F.split("text", "\n", -1)).alias("line")).select("path", "line", words(F.col("line")).alias("words"))
    lines = lines.where(F.arrays_overlap("words", needed)).select("path", "line").distinct()
    lines = materialize(lines.withColumn("words", words(F.col("line"))), "candidates").withColumn("n", F.size("words"))
    terms = lines.select("path", "line", "n", F.explode("words").alias("term")).groupBy("path", "line", "n", "term").agg(F.count("*").alias("tf"))
    weights = df.join(lines.select(F.explode("words").alias("term")).distinct(), "term", "left_semi")
    weights = materialize(weights.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")), "weights")
    few = weights.count() <= BROADCAST_ROWS  # else a shuffle join
    norms = terms.join(F.broadcast(weights) if few else weights, "term").groupBy("path", "line").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("own"))
    return _best(terms, F.broadcast(known), norms)


def directory(path: Column) -> Column:
    """All before the last slash; empty for a path without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, whole: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, license, score, found) of every row of (path, text), with the columns ``keep``; found is own, inherited or null."""
    docs = files.select("path", F.coalesce("text", F.lit("")).alias("text"), *keep)
    own = (own_licenses_whole if whole else own_licenses)(docs.where("path IS NOT NULL"))
    sizes = docs.select("path", *keep, F.size(words(F.col("text"))).alias("all_words"))
    judged = sizes.join(own, "path", "left")
    is_file = F.col("license").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("licensed_words") >= FILE_SHARE * F.col("all_words")))
    given = judged.where(is_file).groupBy(directory(F.col("path")).alias("ancestor")).agg(F.min(F.struct((-F.col("score")).alias("low"), "path", "license")).alias("g"))
    folders = judged.where("path IS NOT NULL AND license IS NULL").select(directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/", -1)
    walk = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))
    ways = folders.select("folder", F.explode(F.when(F.col("folder") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("ancestor")))).otherwise(walk)).alias("w")).select("folder", "w.depth", "w.ancestor")
    nearest = ways.join(given, "ancestor").groupBy("folder").agg(F.max(F.struct("depth", F.col("g.license").alias("license"), (-F.col("g.low")).alias("score"))).alias("near"))
    nearest = materialize(nearest, "nearest")
    few = nearest.count() <= BROADCAST_ROWS  # then a folder of many files makes no task large; else Spark splits the join
    out = judged.withColumn("folder", directory(F.col("path"))).join(F.broadcast(nearest) if few else nearest, "folder", "left")
    found = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull() & F.col("path").isNotNull(), "inherited")
    inherited = found == "inherited"
    return out.select("path", *keep, F.when(inherited, F.col("near.license")).otherwise(F.col("license")).alias("license"), F.when(inherited, F.col("near.score")).otherwise(F.col("score")).alias("score"), found.alias("found"))


def document_paths(docs: DataFrame) -> DataFrame:
    """A document's path: source, language and id, each where known."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select("doc_id", path.alias("path"), "text")


def license_scan(docs: DataFrame, whole: bool = False) -> DataFrame:
    rows = document_paths(docs)
    return scan(rows, whole, ("doc_id",)).select("doc_id", "path", "license", "score", "found")


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
    split = lambda x: f"regexp_extract_all(lower({x}), '{WORD}', 0)"
    return rf"""WITH d AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM d),
t(template, license, text) AS (VALUES {values}),
tc AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({split('text')}) AS term FROM t) q GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT path, unnest(list_distinct({split('text')})) AS term FROM d) q GROUP BY term),
k AS (SELECT tc.*, ln((1 + n.total) / (1 + coalesce(df.df, 0))) + 1 AS idf FROM tc LEFT JOIN df USING (term), n),
kn AS (SELECT template, sqrt(sum(tf * idf * tf * idf)) AS norm FROM k GROUP BY template),
l AS (SELECT DISTINCT path, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM d) q),
lt AS (SELECT path, line, term, count(*) AS tf FROM (SELECT path, line, unnest({split('line')}) AS term FROM l) q GROUP BY ALL),
ln AS (SELECT path, line, sqrt(sum(power(tf * (ln((1 + n.total) / (1 + df.df)) + 1), 2))) AS own FROM lt JOIN df USING (term), n GROUP BY path, line),
s AS (SELECT lt.path, lt.line, k.template, k.license, round(sum(lt.tf * k.idf * k.tf * k.idf) / (max(kn.norm) * max(ln.own)), 6) AS score
  FROM lt JOIN k USING (term) JOIN kn ON kn.template = k.template JOIN ln ON ln.path = lt.path AND ln.line = lt.line GROUP BY lt.path, lt.line, k.template, k.license),
h AS (SELECT * FROM s WHERE score >= {THRESHOLD}),
own AS (SELECT path, license, score FROM (SELECT path, license, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS r FROM h) q WHERE r = 1),
lw AS (SELECT path, sum(len({split('line')})) AS lw FROM (SELECT DISTINCT path, line FROM h) q GROUP BY path),
j AS (SELECT d.doc_id, d.path, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS folder, own.license, own.score, lw.lw, len({split('d.text')}) AS aw FROM d LEFT JOIN own USING (path) LEFT JOIN lw USING (path)),
g AS (SELECT folder AS ancestor, license, score FROM (SELECT folder, license, score, row_number() OVER (PARTITION BY folder ORDER BY score DESC, path) AS r FROM j WHERE license IS NOT NULL AND lw >= {FILE_SHARE} * aw) q WHERE r = 1),
w AS (SELECT folder, g.license, g.score, row_number() OVER (PARTITION BY folder ORDER BY length(ancestor) DESC) AS r FROM (SELECT DISTINCT folder FROM j) f JOIN g ON f.folder = g.ancestor OR starts_with(f.folder, g.ancestor || '/') OR g.ancestor = '')
SELECT j.doc_id, j.path, coalesce(j.license, w.license) AS license, coalesce(j.score, w.score) AS score, CASE WHEN j.license IS NOT NULL THEN 'own' WHEN w.license IS NOT NULL THEN 'inherited' END AS found
FROM j LEFT JOIN w ON w.folder = j.folder AND w.r = 1"""


ORACLE_SQL = _sql()
