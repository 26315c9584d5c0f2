"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (a line) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two. Sums don't depend on order, and a
paragraph is inserted or deleted by adding or subtracting its vector. A vector has two parts:

* LANES lanes modulo 2**64, uniform hash values of the paragraph: two documents agree here only if
  they hold the same paragraphs as often (up to a collision of the hash);
* SKETCH lanes modulo 2**32: a signed count sketch of the paragraph itself and of its WINDOW-byte
  grams. Inner products of these sums estimate inner products of gram counts, so that two
  fingerprints alone give a likeness (the cosine, cut to 0..1; 1 if the fingerprints are equal).

Null texts count as empty. An empty text is one empty paragraph. Likeness with a text that has no
grams in common is about 0, within 1/sqrt(SKETCH).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.session import shuffle_partitions, small_batches

LANES, SKETCH, WINDOW = 8, 256, 16
BLOCK_BYTES = 500_000
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sketch(units: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Signed counts of the hashed units by document and lane."""
    h = _mix(units)
    lane = doc * SKETCH + (h >> np.uint64(56)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(55)) & np.uint64(1)).astype(np.float64)
    return np.bincount(lane, weights=sign, minlength=n * SKETCH).astype(np.int64).reshape(n, SKETCH)


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    digests, counts = [], np.empty(n, np.int64)
    for i, text in enumerate(texts):
        paragraphs = text.split(b"\n")
        counts[i] = len(paragraphs)
        digests += [blake2b(p, digest_size=8 * LANES).digest() for p in paragraphs]
    lanes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, LANES)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    exact = np.add.reduceat(lanes, starts, axis=0)
    sketch = _sketch(lanes[:, 0], np.repeat(np.arange(n), counts), n)

    joined = b"\n".join(texts)
    if len(joined) >= WINDOW:
        raw = np.frombuffer(joined, np.uint8)
        h = raw.astype(np.uint64) + np.uint64(1)
        step = 1
        for m in _MULTIPLIERS:  # each round doubles the bytes that a value covers
            h = h[:-step] * m + h[step:]
            step *= 2
        breaks = np.concatenate(([0], np.cumsum(raw == 10)))
        inside = breaks[WINDOW:] == breaks[: len(h)]
        lengths = np.array([len(t) + 1 for t in texts])
        doc = np.repeat(np.arange(n), lengths)[: len(h)]
        sketch += _sketch(h[inside], doc[inside], n)
    return exact, sketch.astype(np.uint32).view(np.int32)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprints of some texts: uint64 [n, LANES] and int32 [n, SKETCH]."""
    exact, sketch, block, size = [], [], [], 0
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, text in enumerate(raw):
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES or i == len(raw) - 1:
            a, b = _block(block)
            exact.append(a)
            sketch.append(b)
            block, size = [], 0
    if not raw:
        return np.zeros((0, LANES), np.uint64), np.zeros((0, SKETCH), np.int32)
    return np.concatenate(exact), np.concatenate(sketch)


def to_string(exact: np.ndarray, sketch: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + sketch.astype("<i4").tobytes()).decode()


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * LANES], "<u8"), np.frombuffer(raw[8 * LANES :], "<i4")


def combine(fingerprint: str, paragraphs: str, sign: int) -> str:
    """The fingerprint after inserting (sign 1) or deleting (sign -1) the lines of ``paragraphs``."""
    (a, b), (c, d) = from_string(fingerprint), vectors([paragraphs])
    with np.errstate(over="ignore"):
        return to_string(a + c[0], b + d[0]) if sign > 0 else to_string(a - c[0], b - d[0])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, from both parts of two lots of fingerprints: 0 to 1."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = (x * y).sum(1) / np.where(norm > 0, norm, 1)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0, 1))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; repeated rows repeat."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            exact, sketch = vectors(batch["text"].tolist())
            yield pd.DataFrame({"id": batch["id"], "fingerprint": [to_string(a, b) for a, b in zip(exact, sketch)]})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))  # pandas turns longs beside nulls into floats
    return rows.mapInPandas(run, "id string, fingerprint string").select(F.col("id").cast("long").alias(id_col), "fingerprint")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt out so that each one's successor by doc_id comes right after it.

    Ids are cut into ranges of about equal counts. The first row of each range comes once more,
    marked ``ahead``, at the end of the range before it (of the last range, for the first). The
    texts are shuffled once. Null ids come first, ties by text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    n = shuffle_partitions(spark)
    keys = rows.select(F.col("key").cast("double").alias("at"), "key")
    cuts = sorted(set(keys.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n)))
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="part")
    first = {int(r["part"]): r["key"] for r in split.transform(keys).groupBy("part").agg(F.min("key").alias("key")).collect()}  # a row for each range
    order = sorted(first)
    starts = spark.createDataFrame([(first[p], order[i - 1]) for i, p in enumerate(order)], "key long, before int")
    placed = split.transform(rows.withColumn("at", F.col("key").cast("double"))).withColumn("part", F.col("part").cast("int")).join(F.broadcast(starts), "key", "left")
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead"))
    again = F.struct(F.col("before").alias("part"), F.lit(1).alias("ahead"))
    places = F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, again)))
    return (
        placed.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "key", places.alias("at"))
        .select("doc_id", "text", "key", "at.part", "at.ahead")
        .repartitionByRange(n, "part")
        .sortWithinPartitions("part", "ahead", "key", "text")
    )


RESULT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for batch in batches:
        rows = held + list(zip(batch["doc_id"], batch["text"], batch["part"], batch["ahead"]))
        held = rows[-1:]
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[2] == b[2]]
        if not pairs:
            continue
        texts = {id(x): x[1] for pair in pairs for x in pair}
        at = {k: i for i, k in enumerate(texts)}
        own = vectors(list(texts.values()))
        edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
        new = vectors(edited)
        mine, following = np.array([at[id(a)] for a, _ in pairs]), np.array([at[id(b)] for _, b in pairs])
        old, succ = (own[0][mine], own[1][mine]), (own[0][following], own[1][following])
        yield pd.DataFrame({
            "doc_id": [a[0] for a, _ in pairs],
            "n_chars": [len(a[1]) for a, _ in pairs],
            "edited_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            "fingerprint": [to_string(x, y) for x, y in zip(*old)],
            "edited_fingerprint": [to_string(x, y) for x, y in zip(*new)],
            "near_edited": likeness(old, new),
            "near_next": likeness(old, succ),
        })


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """One row for each document, its own fingerprint beside that of its edited text (see RESULT).

    The edited text has the last floor(n/2) code points replaced by the first as many of the next
    document's. A lone document is its own successor. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    rows = docs.sparkSession.createDataFrame([], RESULT) if docs.isEmpty() else with_next(docs).mapInPandas(_against_next, RESULT)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))  # text till here: pandas turns longs beside nulls into floats
