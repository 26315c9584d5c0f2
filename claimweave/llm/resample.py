"""Importance resampling towards a target distribution, with features counted once for each distinct line.

A feature is a run of 1 to ``n`` consecutive words, hashed to one of BUCKETS buckets. Line breaks part words, so a text's features
are those inside its lines and those that cross a break:

* ``segments``: the corpus' distinct lines, each with the number of its occurrences and the buckets of its
  features, which are found once;
* ``crossing``: the features over line breaks, by document (none for n = 1);
* ``counts``: the corpus' features by bucket: those of a line times its occurrences, and those that cross;
* ``weigh``: the gains of a line's features, summed once for each distinct line and joined to the documents that have it
  (those of the few most common lines by broadcast, so that no line's documents meet in one task);
* ``draw``: Gumbel noise from a hash of the id, and the highest scores by a distributed rank.

Null texts count as empty: no words, weight 0. Rows that repeat are rows of their own with equal weight and score; rows
of one doc_id and different texts stay apart. Among equal scores and ids the draw takes the least hash of the text
first. A null doc_id is hashed as an empty one and comes first. An empty table has no rows; an empty target
gives every bucket the gain of t = 0. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import CRC_TABLE, crc_sql, text_or_empty
from claimweave.operators.order import placed
from claimweave.session import materialize

BUCKETS, LEAST_WORDS, PERCENT, SEED, HOT = 10_000, 20, 10, 2024, 2_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SOME_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """Words in order; only A to Z are lower-cased."""
    return F.array_remove(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), NO_WORD), "")


def _longer(runs: Column, words: Column, size: int) -> Column:
    """Runs (text, first, last: the lines of their ends) made longer by the word that follows, to ``size`` words."""
    following = F.slice(words, size, F.greatest(F.size(words), F.lit(1)))
    joined = F.zip_with(runs, following, lambda p, q: F.struct(F.concat(p["text"], F.lit(" "), q["text"]).alias("text"), p["first"].alias("first"), q["last"].alias("last")))
    return F.filter(joined, lambda x: x["text"].isNotNull())  # the last words have none that follows


def _buckets(features: Column) -> Column:
    return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % BUCKETS).cast("int"))


def features(text: Column, n: int, crossing: bool) -> Column:
    """Buckets of the runs of 1 to ``n`` words: those inside lines, or those with words of more than one line. Words don't have line breaks."""
    lines = F.split(text, "\n")
    own = F.flatten(F.transform(lines, lambda line, i: F.transform(words(line), lambda w: F.struct(w.alias("text"), i.alias("first"), i.alias("last")))))
    every, runs = own, own
    for size in range(2, n + 1):
        runs = _longer(runs, own, size)
        every = F.concat(every, runs)
    kept = F.filter(every, lambda x: (x["first"] != x["last"]) if crossing else (x["first"] == x["last"]))
    return _buckets(F.transform(kept, lambda x: x["text"]))


def line_key(line: Column) -> Column:
    return F.unhex(F.left(F.sha2(line, 256), F.lit(32)))


def segments(docs: DataFrame, n: int = 1) -> DataFrame:
    """(key, occurrences, buckets) of each distinct line that has a word."""
    lines = docs.select(F.explode(F.split(text_or_empty(), "\n")).alias("line")).where(F.col("line").rlike(SOME_WORD))
    distinct = lines.groupBy("line").agg(F.count("*").alias("occurrences"))
    return materialize(distinct.select(line_key(F.col("line")).alias("key"), "occurrences", (features(F.col("line"), n, False) if n > 1 else _buckets(words(F.col("line")))).alias("buckets")), "segments")


def crossing(docs: DataFrame, n: int = 1) -> DataFrame:
    """(doc_id, tie, buckets) of the features over line breaks, of the rows that have any."""
    rows = docs.select("doc_id", _tie(), features(text_or_empty(), n, True).alias("buckets"))
    return materialize(rows, "crossing").where(F.size("buckets") > 0) if n > 1 else rows.where("false")


def _tie() -> Column:
    """What parts rows of equal doc_id: a hash of the text."""
    return F.xxhash64(text_or_empty()).alias("tie")


def counts(lines: DataFrame, over: DataFrame) -> DataFrame:
    """(bucket, n): features of the corpus; a row for each of the buckets that occur."""
    rows = lines.select("occurrences", F.explode("buckets").alias("bucket")).unionByName(over.select(F.lit(1).cast("long").alias("occurrences"), F.explode("buckets").alias("bucket")))
    return rows.groupBy("bucket").agg(F.sum("occurrences").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of the buckets of ``source``: the log ratio of smoothed frequencies in thousandths, rounded down. BUCKETS rows at most."""
    total = lambda c: float(c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    all_s, all_t = total(source), total(target)
    both = source.join(target.withColumnRenamed("n", "t"), "bucket", "left")
    odds = (F.coalesce("t", F.lit(0)) + 1).cast("double") * (all_s + BUCKETS) / ((F.col("n") + 1).cast("double") * (all_t + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.ln(odds)).cast("long").alias("gain"))


def weigh(docs: DataFrame, lines: DataFrame, over: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight) of every row: the floored mean of its features' gains."""
    priced = lambda rows, *keys: rows.select(*keys, F.explode("buckets").alias("bucket")).join(F.broadcast(by_bucket), "bucket").groupBy(*keys).agg(F.sum("gain").alias("gain"), F.count("*").alias("features"))
    prices = priced(lines, "key")  # by_bucket has BUCKETS rows at most
    parts = docs.select("doc_id", _tie(), F.posexplode(F.split(text_or_empty(), "\n")).alias("at", "line"))
    has = F.col("line").rlike(SOME_WORD)
    parts = parts.where(has | (F.col("at") == 0)).select("doc_id", "tie", F.when(has, line_key(F.col("line"))).alias("key"), (F.col("at") == 0).cast("long").alias("copies"))
    # lines that hold more than a part in HOT of all occurrences, less than HOT of them, are broadcast; the rest is shuffled, without rows that need nothing of it
    times = lines.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    common = lines.where(F.col("occurrences") * HOT > times).select("key")
    prices = materialize(prices, "prices")
    hot = prices.join(F.broadcast(common), "key", "left_semi").toDF("key", "hot_gain", "hot_features")
    parts = parts.join(F.broadcast(hot), "key", "left")
    alone = F.col("key").isNull() | F.col("hot_gain").isNotNull()
    other = F.unhex(F.lpad(F.hex(F.xxhash64("doc_id", "tie", "copies")), 16, "0"))  # 8 bytes, so it is no line's key, and spreads these rows
    parts = parts.withColumn("key", F.when(alone, other).otherwise(F.col("key"))).join(prices, "key", "left")
    parts = parts.select("doc_id", "tie", "copies", F.coalesce("hot_gain", "gain").alias("gain"), F.coalesce("hot_features", "features").alias("features"))
    more = priced(over, "doc_id", "tie").withColumn("copies", F.lit(0).cast("long"))
    sums = parts.unionByName(more).groupBy("doc_id", "tie").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("copies", "gain", "features")])
    each = sums.withColumns({"gain": F.expr("gain div copies"), "features": F.expr("features div copies")})
    weight = F.expr("coalesce((gain - pmod(gain, nullif(features, 0))) div nullif(features, 0), 0)")
    return each.select("doc_id", "tie", F.col("features").alias("n_features"), weight.alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def noisy(weight: Column, seed: int = SEED) -> Column:
    """The weight with Gumbel noise, in thousandths, from a hash of the doc_id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """The rows with score and rank: 1, 2, 3, ... for the highest scores of ``percent`` of the eligible rows, rounded down, null for the others."""
    scored = materialize(weighed.withColumn("score", noisy(F.col("weight"))).withColumn("eligible", F.coalesce(eligible, F.lit(False))), "scored")
    n = scored.where("eligible").count() * percent // 100
    ranked = placed(scored.where("eligible"), [], [F.desc("score"), F.asc("doc_id"), F.asc("tie"), F.asc("copy")])
    ranked = ranked.select(*weighed.columns, "score", F.when(F.col("place") < n, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.where("NOT eligible").select(*weighed.columns, "score", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document. ``least`` is in features of one word, so in words where n is 1.

    For n > 1 a document of w words has w + (w - 1) + ... features, from which w follows."""
    lines, over = segments(docs, n), crossing(docs, n)
    by_bucket = materialize(gains(counts(lines, over), counts(segments(target, n), crossing(target.select(F.lit(None).alias("doc_id"), "text"), n))), "gains")
    rows = weigh(docs, lines, over, by_bucket)
    most = sum(max(least - size + 1, 0) for size in range(1, n + 1))  # features of a text of ``least`` words
    return draw(rows, F.col("n_features") >= most, percent).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
found AS (SELECT r, unnest(regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w FROM docs),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w FROM benchmark),
hashed AS (SELECT w, {crc_sql("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM found UNION SELECT w FROM wanted) d, {CRC_TABLE} c),
s AS (SELECT bucket, count(*) AS n FROM found JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + {BUCKETS}) AS DOUBLE) / CAST((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM found JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
weighed AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM docs LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS many FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN n_features >= {LEAST_WORDS} AND place <= many * {PERCENT} // 100 THEN place END AS BIGINT) AS rank FROM ranked"""
