"""Planning: yields of past searches, scores of pending ones, slots, targeted queries, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.operators import conflicts as clash
from claimweave.operators import lookups

RECENT = 50
YIELD = (("new_evidence", 0.45), ("new_interactions", 0.85), ("papers_new", 0.15), ("improved", 1.5))


def yields(searches: DataFrame, keys: list[str], recent: int = RECENT) -> DataFrame:
    """By key: means over the ``recent`` latest finished searches, and their yield score. Null keys are keys."""
    w = W.partitionBy(*keys).orderBy(F.desc("completed_at"), F.desc("id"))
    last = searches.where("status = 'done'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= recent)
    means = last.groupBy(*keys).agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c, _ in YIELD])
    score = sum((F.col(f"avg_{c}") * w_ for c, w_ in YIELD), F.lit(0.0))
    return means.withColumn("yield_score", F.round(score, 4))


def learned(searches: DataFrame, pending: DataFrame) -> DataFrame:
    """The pending searches with learned_yield: of searches of the same type, kind and reason, if there are two; else of type and kind; else 0.

    A null kind or reason in the question is no filter; so each question's own keys choose the grouping."""
    by = ["query_type", "target_kind", "generation_reason"]
    exact = yields(searches, by).where("n >= 2").select(*by, F.col("yield_score").alias("specific"))
    broad = yields(searches, by[:2]).where("n >= 2").select(*by[:2], F.col("yield_score").alias("wide"))
    typed = yields(searches, by[:1]).where("n >= 2").select("query_type", F.col("yield_score").alias("any_kind"))
    reasoned = yields(searches, ["query_type", "generation_reason"]).where("n >= 2").select("query_type", "generation_reason", F.col("yield_score").alias("any_kind_reason"))
    rows = pending.join(F.broadcast(exact), by, "left").join(F.broadcast(broad), by[:2], "left")  # a row for each combination of closed lists
    rows = rows.join(F.broadcast(typed), "query_type", "left").join(F.broadcast(reasoned), ["query_type", "generation_reason"], "left")
    open_kind = F.col("target_kind").isNull()
    value = F.when(open_kind, F.coalesce("any_kind_reason", "any_kind")).otherwise(F.coalesce("specific", "wide"))
    return rows.withColumn("learned_yield", F.coalesce(value, F.lit(0.0))).drop("specific", "wide", "any_kind", "any_kind_reason")


def score_pending(pending: DataFrame, searches: DataFrame, entities: DataFrame, conflicts: DataFrame | None = None, penalty: float = 1.0) -> DataFrame:
    """(id, planning_score, learned_yield): the estimated gain of each pending search.

    A search whose ``origin`` is ``conflict_id:`` and the id of a conflict gains that conflict's weight times the penalty."""
    rows = learned(searches, pending).join(entities.select(F.col("id").alias("target_id"), "paper_count"), "target_id", "left")
    if conflicts is None:
        rows = rows.withColumn("weight", F.lit(0.0))
    else:
        named = F.when(F.startswith("origin", F.lit("conflict_id:")), F.substr("origin", F.lit(13)))
        rows = rows.withColumn("conflict", named).join(conflicts.select(F.col("id").alias("conflict"), F.col("penalty_weight").alias("weight")), "conflict", "left")
    kind, is_clash = F.col("target_kind"), F.col("query_type") == "conflict_resolution"
    weight = F.coalesce("weight", F.lit(0.0)) * penalty
    gain = F.when(is_clash, 1.0).when(kind == "entity", 1.8 + F.coalesce(F.least(F.col("paper_count").cast("double"), F.lit(10.0)) / 10, F.lit(0.0))).when(kind == "interaction", 2.2).otherwise(1.2)
    less = F.when(is_clash, 2.0 + weight).otherwise(0.0)
    noise = F.when(is_clash, 0.0).when(kind == "entity", 0.4).when(kind == "interaction", 0.2).when(F.col("query_type") == "entity_expansion", 0.8).otherwise(0.5)
    noise = noise + F.when(F.col("learned_yield") < 0.5, 0.3).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    prior = zero("new_evidence") + zero("new_interactions") * 1.5 + zero("papers_new") * 0.5
    return rows.select("id", F.round(gain + less + prior + F.col("learned_yield") - noise, 4).alias("planning_score"), "learned_yield")


def allocate(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Slots for each family in proportion to its weight (0.5 at least), one at least, in whole numbers by rounding half to even.

    What is missing from the sum goes to the heaviest family; what is too much is taken one by one from the largest share, never its last."""
    held = {k: max(0.5, v) for k, v in weights.items()}
    share = {k: max(1, round(v / sum(held.values()) * slots)) for k, v in held.items()}
    spare = slots - sum(share.values())
    share[max(held, key=held.get)] += max(0, spare)
    for _ in range(max(0, -spare)):
        most = max(share, key=share.get)
        share[most] -= share[most] > 1
    return share


def targeted(conflicts: DataFrame, interactions: DataFrame, entities: DataFrame, slots: dict[str, int], evidence: DataFrame | None = None, fewest: int = 3, most_evidence: int = 1, sides: DataFrame | None = None, curated: DataFrame | None = None) -> DataFrame:
    """(origin, reason, query_text, planning_score) for conflict hubs, sparse entities and weakly supported interactions that a curated source has.

    ``sides``: interactions among which all sides of conflicts are; ``curated``: those that a curated source has, else found by ``evidence``."""
    hubs = clash.hubs(conflicts, interactions if sides is None else sides, entities, slots["conflict"]).select(
        F.concat(F.lit("conflict_id:"), "id").alias("origin"), F.lit("unresolved_conflict_hub").alias("reason"),
        F.format_string('"%s"[Title/Abstract] AND "%s"[Title/Abstract] AND (%s OR mechanism OR context OR condition)', "name_a", "name_b", F.coalesce("type_a", "type_b", F.lit("interaction"))).alias("query_text"),
        F.round(3.0 + F.coalesce("penalty_weight", F.lit(0.0)), 4).alias("planning_score"),
    )
    sparse = lookups.sparse_entities(entities, interactions, fewest, slots["entity"]).select(
        F.concat(F.lit("entity_id:"), "id").alias("origin"), F.lit("sparse_high_value_entity").alias("reason"),
        F.format_string('"%s"[Title/Abstract] AND (interaction OR signaling OR regulation OR binding)', "canonical_name").alias("query_text"),
        F.round(2.0 + F.least(F.col("paper_count").cast("double"), F.lit(10.0)) / 10 - F.col("degree") * 0.25, 4).alias("planning_score"),
    )
    names = entities.select("id", "canonical_name")
    if curated is None:
        curated = interactions.join(evidence.where("evidence_type = 'curated_db'").select(F.col("interaction_id").alias("id")), "id", "left_semi")
    weak = curated.where(F.col("evidence_count") <= most_evidence).orderBy(F.desc("score"), "evidence_count", "id").limit(slots["interaction"])
    weak = weak.join(names.toDF("entity_a", "name_a"), "entity_a").join(names.toDF("entity_b", "name_b"), "entity_b").select(
        F.concat(F.lit("interaction_id:"), "id").alias("origin"), F.lit("under_supported_seeded_interaction").alias("reason"),
        F.format_string('"%s"[Title/Abstract] AND "%s"[Title/Abstract] AND (%s OR interaction OR mechanism)', "name_a", "name_b", "interaction_type").alias("query_text"),
        F.round(2.6 + F.greatest(F.lit(0.0), 1.0 - F.col("evidence_count")), 4).alias("planning_score"),
    )
    return hubs.unionAll(sparse).unionAll(weak)


def attribute(papers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """By query: what its papers brought; a paper of several queries counts for each with an equal share."""
    shares = papers.select("id", F.explode("query_ids").alias("query_id"), (1 / F.size("query_ids")).alias("share"))
    joined = shares.join(outcomes.withColumnRenamed("paper_id", "id"), "id")
    return joined.groupBy("query_id").agg(F.round(F.sum(F.col("share") * F.col("n_interactions")), 6).alias("attributed_interactions"), F.round(F.sum(F.col("share") * F.col("n_evidence")), 6).alias("attributed_evidence"), F.count("*").alias("papers"))


def merge_papers(papers: DataFrame) -> DataFrame:
    """One row for each id: all its queries (sorted), its highest priority, the first title that isn't null in order of arrival."""
    return papers.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("query_ids")))).alias("query_ids"), F.max("priority").alias("priority"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("arrival"))).alias("title"))
