"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Short test items are looked for inside long documents. Texts are lower-cased words of letters and
digits; an item's shingles have WORDS words (an item with fewer words is one shingle of them all).
Items are partitioned by the power of two below their number of shingles. Each item keeps the
bottom-k of its shingles in the order of a hash, with k one more than the shingles that a document
may lack at THRESHOLD, taken at its partition's largest size; so a document that contains the item
holds at least one of them, and nothing is lost. Every position of every document is probed against
these sketches. Documents with a candidate are verified on the shingles themselves: each shingle, as text, meets
those of the candidate items once, and hits are counted before the shuffle, so no document is copied for each item.

Null and empty texts have no shingles: such items are in no document, such documents hold none.
Rows that repeat give pairs that repeat once; of several texts under one id each counts by itself, and the best is given.
Empty tables give an empty result. The sketches are broadcast if they are at most BROADCAST_ROWS, the shingles of
candidate items if at most BROADCAST_GRAMS; beyond that the joins are left to the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize

WORDS, THRESHOLD, BROADCAST_ROWS, BROADCAST_GRAMS = 5, 0.8, 500_000, 200_000
GAP = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")


def _shingles(width: Column | int, made) -> Column:
    """An array over the positions of ``w``; empty if there are fewer words than ``width``."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size("w") - width + 1
    return F.when(last < 1, F.array().cast(made(F.array(F.lit("")))[1])).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: made(F.slice("w", i, width))[0]))


def _hashed(words: Column) -> tuple[Column, str]:
    return F.xxhash64(words), "array<bigint>"


def _joined(words: Column) -> tuple[Column, str]:
    return F.array_join(words, " "), "array<string>"


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, n, part, grams, sketch): an item's distinct shingles, and hashes of its bottom-k."""
    rows = benchmark.select("item_id", _words(F.col("text")).alias("w")).where("item_id IS NOT NULL AND size(w) > 0").dropDuplicates(["item_id", "w"])
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(WORDS)))
    rows = rows.withColumn("grams", F.array_distinct(_shingles(F.col("width"), _joined))).withColumn("hashes", F.array_distinct(_shingles(F.col("width"), _hashed)))
    rows = rows.withColumn("n", F.size("grams")).withColumn("part", F.floor(F.log2("n")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("part") + 1) - 1
    k = (F.floor(largest * (1 - THRESHOLD) + 1e-9) + 1).cast("int")
    order = F.array_sort(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit("order")).alias("by"), h.alias("h"))))
    return rows.select("item_id", "width", "n", "part", "grams", F.transform(F.slice(order, 1, k), lambda x: x["h"]).alias("sketch"))


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, containment): the pairs at THRESHOLD or more."""
    items = items_of(benchmark)
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most WORDS values
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, containment double")
    if not widths:
        return empty
    sketches = items.select("item_id", F.explode("sketch").alias("h"))
    small = sketches.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    words = rows.select("doc_id", _words(F.col("text")).alias("w"))
    hashes = _shingles(widths[0], _hashed)
    if len(widths) > 1:
        hashes = F.concat(*[_shingles(w, _hashed) for w in widths])
    probes = words.select("doc_id", F.explode(hashes).alias("h"))
    found = probes.join(F.broadcast(sketches) if small else sketches, "h").select("doc_id", "item_id").distinct()
    found = materialize(found, "candidates")
    whole = items.join(found.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "n", F.explode("grams").alias("gram"))
    texts = rows.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("version"), _words(F.col("text")).alias("w"))
    grams = F.concat(*[_shingles(w, _joined) for w in widths])
    has = texts.select("doc_id", "version", F.explode(F.array_distinct(grams)).alias("gram"))
    hits = has.join(F.broadcast(whole) if whole.count() <= BROADCAST_GRAMS else whole, "gram")
    versions = hits.groupBy("doc_id", "version", "item_id").agg(F.count_distinct("gram").alias("shared"), F.max("n").alias("n"))
    both = versions.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), "shared")).alias("x"))
    both = both.where(F.col("x.containment") >= THRESHOLD).join(found, ["doc_id", "item_id"], "left_semi")
    return both.select("doc_id", "item_id", F.col("x.shared").cast("long").alias("n_shared"), F.col("x.containment").alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were."""
    leaked = contained(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


ORACLE_SQL = f"""WITH iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{GAP}'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {WORDS}) AS k FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p) x),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{GAP}'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS g FROM dw, (SELECT DISTINCT k FROM ig) ks, LATERAL (SELECT unnest(range(1, CAST(greatest(len(w) - k + 2, 1) AS BIGINT))) AS p) x)
SELECT dg.doc_id, ig.item_id, CAST(count(*) AS BIGINT) AS n_shared, count(*) / CAST(max(n.n) AS DOUBLE) AS containment
FROM dg JOIN ig ON dg.g = ig.g JOIN n ON n.item_id = ig.item_id GROUP BY dg.doc_id, ig.item_id HAVING count(*) >= {THRESHOLD} * max(n.n)"""
