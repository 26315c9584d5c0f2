"""Composite confidence and evidence summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.functions import vocab
from claimweave.functions.numbers import exact_round

EDGE = ("entity_a", "entity_b", "interaction_type", "effect", "direction")


def label(n: Column, score: Column) -> Column:
    high = ((n >= 3) & (score >= 0.5)) | (score >= 0.65) | ((n >= 2) & (score >= 0.55))
    return F.when(high, "high").when(score >= 0.4, "medium").otherwise("low")


def sums(evidence: DataFrame, *more: str) -> DataFrame:
    """(id, ..., evidence_count, weighted, weight) of each interaction: what its score is made of, and what can be added up batch by batch."""
    weight = vocab.lookup(vocab.EVIDENCE_WEIGHT, F.col("evidence_type"), 0.7)
    rows = evidence.groupBy(F.col("interaction_id").alias("id"), *EDGE, *more)
    return rows.agg(F.count("*").alias("evidence_count"), F.sum(F.col("confidence_score") * weight).alias("weighted"), F.sum(weight).alias("weight"))


def merged(old: DataFrame, new: DataFrame, *more: str) -> DataFrame:
    """The sums of both, by interaction."""
    return old.unionByName(new).groupBy("id", *EDGE, *more).agg(*[F.sum(c).alias(c) for c in ("evidence_count", "weighted", "weight")])


def scored(sums: DataFrame) -> DataFrame:
    """The sums with the evidence-weighted mean (rounded to 4) and its label (of the unrounded mean)."""
    raw = F.col("weighted") / F.col("weight")
    return sums.withColumns({"score": exact_round(raw, 4), "label": label(F.col("evidence_count"), raw)})


def composite(evidence: DataFrame) -> DataFrame:
    """A row for each interaction: its number of pieces of evidence, score and label."""
    return scored(sums(evidence)).drop("weighted", "weight")


def strongest(interactions: DataFrame, limit: int) -> DataFrame:
    return interactions.orderBy(F.desc("score"), F.desc("evidence_count"), "id").limit(limit)


def adjudicate(evidence: DataFrame) -> DataFrame:
    """The evidence with its adjudication score and note; ``year`` is that of its paper."""
    quality = vocab.lookup(vocab.EVIDENCE_QUALITY, F.coalesce("evidence_type", F.lit("unknown")), 0.3)
    verification = F.when(F.coalesce("verification_score", F.lit(0.0)) == 0, 0.4).otherwise(F.col("verification_score"))
    has = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 0.1).otherwise(0.0)
    directness = F.when(F.coalesce("snippet", F.lit("")) != "", 0.85).otherwise(0.3)
    context = 0.1 + has("norm_organism") + has("norm_tissue") + has("norm_condition")
    rows = evidence.withColumns({"q": quality, "v": verification, "d": directness, "c": context, "r": vocab.recency(F.col("year"))})
    score = F.col("q") * 0.35 + F.col("v") * 0.3 + F.col("d") * 0.15 + F.col("c") * 0.1 + F.col("r") * 0.1
    note = F.format_string("quality=%.2f; verification=%.2f; directness=%.2f; context=%.2f; recency=%.2f", "q", "v", "d", "c", "r")
    return rows.withColumn("adjudication_score", exact_round(score, 4)).withColumn("note", note).drop("q", "v", "d", "c", "r")


def with_contexts(evidence: DataFrame) -> DataFrame:
    """Normalised organism, tissue and condition beside the raw ones; and the assay, by its type or else the subtype of the evidence, where these columns are there."""
    given = [F.nullif(F.col(c), F.lit("")) for c in ("assay_type", "evidence_subtype") if c in evidence.columns]
    assay = {"norm_assay": vocab.normalise(F.coalesce(*given), vocab.ASSAY_RULES, "assay")} if given else {}
    return evidence.withColumns(assay | {
        "norm_organism": vocab.normalise(F.col("organism"), vocab.ORGANISM_RULES, "organism"),
        "norm_tissue": vocab.normalise(F.col("tissue_cell_type"), vocab.TISSUE_RULES, "context"),
        "norm_condition": vocab.normalise(F.col("condition"), vocab.CONDITION_RULES, "condition"),
    })


def context(*columns: str) -> Column:
    """Non-empty context values joined by a bar; null where all are empty."""
    return F.nullif(F.concat_ws("|", *[F.nullif(F.col(c), F.lit("")) for c in columns]), F.lit(""))


def summarise(adjudicated: DataFrame) -> DataFrame:
    """By interaction: mean and best score, mean verification, contexts (sorted), the best paper (ties: the first id)."""
    units, n = lambda c: F.sum(F.round(c * 10_000).cast("long")), F.count("*")
    mean = lambda c: F.floor((units(c) + n / 2) / n) / 10_000.0  # noqa: E731  in whole units: the order of rows has no effect
    score, check = F.coalesce("adjudication_score", F.lit(0.0)), F.coalesce("verification_score", F.lit(0.0))
    return adjudicated.groupBy("interaction_id").agg(
        F.count("*").alias("n"),
        mean(score).alias("mean_score"),
        F.round(F.max(score), 4).alias("max_score"),
        mean(check).alias("mean_verification"),
        F.sort_array(F.collect_set(context("norm_organism", "norm_tissue", "norm_condition"))).alias("contexts"),
        F.min(F.struct((-score).alias("low"), "id", "paper_id")).alias("best"),
    ).withColumn("best_paper_id", F.col("best.paper_id")).drop("best")


def first_lines(adjudicated: DataFrame, limit: int = 5) -> DataFrame:
    """Up to ``limit`` lines of text for each interaction, best evidence first."""
    w = W.partitionBy("interaction_id").orderBy(F.desc("adjudication_score"), "id")
    line = F.format_string("%s | %s | %.2f", "paper_id", "evidence_type", "confidence_score")
    return adjudicated.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("interaction_id", "place", line.alias("line"))


def dedup_claims(claims: DataFrame) -> DataFrame:
    """One claim for each (a, b, type, effect, direction, snippet) without regard to case: the highest score, the first of equals."""
    keys = [F.lower("entity_a"), F.lower("entity_b"), F.col("interaction_type"), F.lower(F.coalesce("effect", F.lit(""))), F.coalesce("direction", F.lit("")), F.trim(F.coalesce("snippet", F.lit("")))]
    named = claims.select(*[k.alias(n) for k, n in zip(keys, ("a", "b", "kind", "effect", "direction", "snippet"))], "confidence_score", "paper_id", "line_no")
    best = F.min(F.struct((-F.col("confidence_score")).alias("low"), "paper_id", "line_no")).alias("x")
    return named.groupBy("a", "b", "kind", "effect", "direction", "snippet").agg(best).select("a", "b", "kind", "effect", "direction", "snippet", (-F.col("x.low")).alias("confidence_score"), "x.paper_id")


def percentiles(rows: DataFrame, key: str, value: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """By key: the value at place int(n * p / 100) of the sorted values, the last at most.

    Equal values are counted before the shuffle; the window sums a row for each different value, of which rounded scores have
    10,001 at most, however many rows a key has."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("rows"))
    w = W.partitionBy(key)
    upto = F.sum("rows").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.select(key, value, upto.alias("upto"), F.sum("rows").over(w).alias("n"))
    place = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return placed.groupBy(key).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(f"p{p}") for p in points])
