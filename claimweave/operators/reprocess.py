"""Reprocessing of what is stored: contexts, adjudication, literal claims and conflicts anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import vocab
from claimweave.operators import confidence, conflicts

# The members of the two enumerations.
INTERACTION_TYPES = (
    "direct_binding", "enzymatic", "signaling", "genetic", "transcriptional", "translational", "post_translational", "metabolic",
    "proximal_association", "co_expression", "transport", "unknown",
)
EVIDENCE_TYPES = ("in_vitro", "in_vivo", "structural", "computational", "co_expression", "genetic_screen", "clinical", "curated_db", "cited_claim", "unknown")


def coerce(value: Column, members: tuple[str, ...]) -> Column:
    """A member of an enumeration; anything else, null too, is unknown."""
    return F.when(value.isin(*members), value).otherwise("unknown")


def joined(evidence: DataFrame, interactions: DataFrame, papers: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence with its interaction's effect, direction and type, its paper's year and both names; pieces that lack any of them go."""
    edges = interactions.select(F.col("id").alias("interaction_id"), "entity_a", "entity_b", "effect", "direction", "interaction_type")
    own = evidence.drop("entity_a", "entity_b", "effect", "direction", "interaction_type", "year")
    names = entities.select("id", "canonical_name")
    rows = own.join(edges, "interaction_id").join(papers.select(F.col("id").alias("paper_id"), "year"), "paper_id")
    return rows.join(names.toDF("entity_a", "name_a"), "entity_a").join(names.toDF("entity_b", "name_b"), "entity_b")


def backfill(rows: DataFrame) -> DataFrame:
    """Rows of joined() with normalised contexts, adjudication, coerced types, and a claim id: their own, or one after the evidence."""
    with_types = rows.withColumns({"interaction_type": coerce(F.col("interaction_type"), INTERACTION_TYPES), "evidence_type": coerce(F.col("evidence_type"), EVIDENCE_TYPES)})
    out = confidence.adjudicate(confidence.with_contexts(with_types))
    claim = F.col("claim_id") if "claim_id" in rows.columns else F.lit(None).cast("string")
    missing = F.coalesce(claim, F.lit("")) == ""
    return out.withColumns({"backfilled": missing, "claim_id": F.when(missing, F.concat(F.lit("claim:"), "id")).otherwise(claim)})


def backfilled_claims(rows: DataFrame) -> DataFrame:
    """Literal claims for the evidence of backfill() that had none."""
    return rows.where("backfilled").select("claim_id", "paper_id", F.col("name_a").alias("entity_a_text"), F.col("name_b").alias("entity_b_text"), F.col("interaction_type").alias("interaction_type_text"), F.col("direction").alias("direction_text"), F.col("effect").alias("effect_text"), F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def refresh(known: DataFrame, interactions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Conflicts after detection and analysis: known ones and new ones, with the outcomes that the evidence recommends for open ones."""
    adjudicated = confidence.adjudicate(evidence)
    every = known.unionByName(conflicts.detect(interactions, evidence, known))
    opened = every.where(F.col("status").isin(*vocab.OPEN))
    return conflicts.resolve(every, conflicts.outcomes(opened, adjudicated))
