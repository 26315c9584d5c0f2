"""Conflicts between interactions: candidates, classes, outcomes and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import vocab
from claimweave.operators.confidence import summarise
from claimweave.session import materialize

FLIPPED = {"A_to_B": "B_to_A", "B_to_A": "A_to_B"}


def candidates(interactions: DataFrame, evidence: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(interaction_a, interaction_b, reversed): pairs on the same two entities and type that disagree.

    They differ in effect (both given) or in direction (neither undirected; null counts as that).
    Each side has a paper that the other lacks. Pairs in ``known``, either way round, are left out.
    The join is on the pair of entities and the type; reversed pairs are a second join, the same
    way. A self-loop meets itself in the first only. Papers are counted, not carried: each side
    has one of its own if it has more papers than the two share."""
    rows = interactions.select("id", "entity_a", "entity_b", "interaction_type", "effect", F.coalesce("direction", F.lit("undirected")).alias("direction"))
    right = rows.select(*[F.col(c).alias(f"{c}_2") for c in rows.columns])
    kind = F.col("interaction_type") == F.col("interaction_type_2")
    directed = (F.lower("direction") != "undirected") & (F.lower("direction_2") != "undirected")
    differ = F.coalesce(F.col("effect") != F.col("effect_2"), F.lit(False)) | (directed & (F.col("direction") != F.col("direction_2")))
    ahead = rows.join(right, (F.col("entity_a") == F.col("entity_a_2")) & (F.col("entity_b") == F.col("entity_b_2")) & kind & (F.col("id") < F.col("id_2")) & differ)
    back = rows.join(right, (F.col("entity_a") == F.col("entity_b_2")) & (F.col("entity_b") == F.col("entity_a_2")) & kind & (F.col("id") < F.col("id_2")) & differ).where("entity_a != entity_b")
    both = ahead.withColumn("reversed", F.lit(False)).unionAll(back.withColumn("reversed", F.lit(True)))
    pairs = both.select(F.col("id").alias("interaction_a"), F.col("id_2").alias("interaction_b"), "reversed")
    if known is not None:
        ends = known.select(F.least("interaction_a", "interaction_b").alias("interaction_a"), F.greatest("interaction_a", "interaction_b").alias("interaction_b"))
        pairs = pairs.join(ends, ["interaction_a", "interaction_b"], "left_anti")
    pairs = materialize(pairs, "pairs")  # three joins read them
    papers = evidence.select(F.col("interaction_id").alias("id"), "paper_id").distinct()
    sizes = papers.groupBy("id").agg(F.count("*").alias("n"))
    pairs = pairs.join(sizes.toDF("interaction_a", "na"), "interaction_a").join(sizes.toDF("interaction_b", "nb"), "interaction_b")
    common = pairs.join(papers.toDF("interaction_a", "paper"), "interaction_a").join(papers.toDF("interaction_b", "paper"), ["interaction_b", "paper"])
    common = materialize(common.groupBy("interaction_a", "interaction_b").agg(F.count("*").alias("shared")), "common")
    pairs = pairs.join(common, ["interaction_a", "interaction_b"], "left").fillna({"shared": 0})
    return pairs.where("na > shared AND nb > shared").select("interaction_a", "interaction_b", "reversed")


def context_sets(evidence: DataFrame) -> DataFrame:
    """By interaction: sets of organisms, tissues and conditions, normalised where known."""
    value = lambda n, r: F.coalesce(F.nullif(F.col(n), F.lit("")), F.nullif(F.col(r), F.lit("")))
    return evidence.groupBy("interaction_id").agg(
        F.collect_set(value("norm_organism", "organism")).alias("organisms"),
        F.collect_set(value("norm_tissue", "tissue_cell_type")).alias("tissues"),
        F.collect_set(value("norm_condition", "condition")).alias("conditions"),
    )


def _differ(a: str, b: str) -> Column:
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def classify(pairs: DataFrame, interactions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The pairs with axis, type and penalty: context-dependent where contexts are disjoint, else ambiguous."""
    side = interactions.select("id", "effect", "direction").join(contexts.withColumnRenamed("interaction_id", "id"), "id", "left")
    empty = F.array().cast("array<string>")
    side = side.withColumns({c: F.coalesce(c, empty) for c in ("organisms", "tissues", "conditions")})
    a, b = side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns]), side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns])
    rows = pairs.join(a, pairs["interaction_a"] == a["a_id"]).join(b, pairs["interaction_b"] == b["b_id"])
    effect = F.coalesce(F.col("a_effect") != F.col("b_effect"), F.lit(False))
    undirected = F.coalesce(F.col("a_direction") == "undirected", F.lit(False)) | F.coalesce(F.col("b_direction") == "undirected", F.lit(False))
    direction = ~F.col("a_direction").eqNullSafe(F.col("b_direction")) & ~undirected
    alien = _differ("a_organisms", "b_organisms") & ~F.arrays_overlap("a_organisms", "b_organisms")
    elsewhere = (_differ("a_tissues", "b_tissues") | _differ("a_conditions", "b_conditions")) & ~F.arrays_overlap("a_tissues", "b_tissues") & ~F.arrays_overlap("a_conditions", "b_conditions")
    kind = F.when(alien | elsewhere, "context_dependent").otherwise("ambiguous")
    out = rows.select("interaction_a", "interaction_b", F.when(direction & ~effect, "direction").otherwise("effect").alias("conflict_axis"), kind.alias("conflict_type"))
    return out.withColumns({"penalty_weight": vocab.lookup(vocab.PENALTY, F.col("conflict_type"), 0.0), "status": F.lit("open"), "id": F.concat_ws("~", "interaction_a", "interaction_b")})


def detect(interactions: DataFrame, evidence: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates, classified; ``evidence`` has normalised contexts."""
    return classify(materialize(candidates(interactions, evidence, known), "candidates"), interactions, context_sets(evidence))


#: What is noted with a conflict that the evidence settles.
NOTES = {
    "sure": "Adjudication indicates both claims are supported but in distinct normalized contexts, favoring a context-dependent interpretation.",
    "true": "Adjudication found a strong evidence-quality gap under comparable contexts, favoring one claim as the current best-supported interpretation.",
    "kept": "Normalized context differences support resolving this conflict as context-dependent.",
}


def outcomes(conflicts: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """What the evidence recommends for each conflict, with a note; conflicts without a recommendation are left out."""
    stats = summarise(adjudicated).select("interaction_id", "mean_score", "contexts", "best_paper_id")
    a, b = stats.select(*[F.col(c).alias(f"a_{c}") for c in stats.columns]), stats.select(*[F.col(c).alias(f"b_{c}") for c in stats.columns])
    rows = conflicts.join(a, conflicts["interaction_a"] == a["a_interaction_id"], "left").join(b, conflicts["interaction_b"] == b["b_interaction_id"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("a_contexts", "b_contexts")}).fillna({"a_mean_score": 0.0, "b_mean_score": 0.0})
    overlap = F.arrays_overlap("a_contexts", "b_contexts")
    some = (F.size("a_contexts") > 0) & (F.size("b_contexts") > 0)
    same = overlap | ((F.size("a_contexts") == 0) & (F.size("b_contexts") == 0))
    distinct, gap = some & ~overlap, F.abs(F.col("a_mean_score") - F.col("b_mean_score"))
    sure = distinct & (F.least("a_mean_score", "b_mean_score") >= 0.45)
    true = same & (gap >= 0.3)
    kept = (F.col("conflict_type") == "context_dependent") & distinct
    kind = F.when(sure | (~true & kept), "context_dependent").when(true, "true_conflict")
    note = F.when(sure, NOTES["sure"]).when(true, NOTES["true"]).when(kept, NOTES["kept"])
    paper = F.when(~sure & true, F.when(F.col("a_mean_score") >= F.col("b_mean_score"), F.col("a_best_paper_id")).otherwise(F.col("b_best_paper_id")))
    out = rows.select("id", kind.alias("recommended"), F.lit("resolved").alias("status"), paper.alias("resolution_paper_id"), note.alias("note")).where("recommended IS NOT NULL")
    return out.withColumn("penalty_weight", vocab.lookup(vocab.PENALTY, F.col("recommended"), 0.0))


def resolve(conflicts: DataFrame, recommended: DataFrame) -> DataFrame:
    """The conflicts with the recommendations taken over; what a recommendation leaves null stays."""
    new = recommended.select("id", F.col("recommended").alias("new_type"), F.col("status").alias("new_status"), F.col("penalty_weight").alias("new_weight"), F.col("resolution_paper_id").alias("new_paper"))
    old = conflicts if "resolution_paper_id" in conflicts.columns else conflicts.withColumn("resolution_paper_id", F.lit(None).cast("string"))
    taken = {"conflict_type": "new_type", "status": "new_status", "penalty_weight": "new_weight", "resolution_paper_id": "new_paper"}
    return old.join(new, "id", "left").withColumns({was: F.coalesce(now, was) for was, now in taken.items()}).drop(*taken.values())


def reopen(conflicts: DataFrame, changed: DataFrame) -> DataFrame:
    """Conflicts that touch a changed interaction (id) and aren't open are reopened, without their paper."""
    sides = conflicts.select("id", F.explode(F.array("interaction_a", "interaction_b")).alias("side"))
    hit = sides.join(changed.select(F.col("id").alias("side")), "side", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    joined = conflicts.join(hit, "id", "left")
    again = F.col("hit").isNotNull() & F.col("status").isin("investigating", "resolved", "dismissed")
    return joined.withColumns({"status": F.when(again, "reopened").otherwise(F.col("status")), "resolution_paper_id": F.when(~again, F.col("resolution_paper_id"))}).drop("hit")


ANALYSIS = 5000


def analyse(conflicts: DataFrame, adjudicated: DataFrame, model, limit: int | None = None) -> DataFrame:
    """The conflicts after an analysis of the heaviest ``limit`` open ones, with the ``analysis`` text of those that changed.

    What the evidence recommends resolves a conflict. Of the others, those that are ambiguous take the type, weight and reasons (id,
    verdict, weight, reasons; a type or weight of null is ambiguous, 0.5) that ``model`` gives them, a function of
    their rows, and stay open. A conflict without an answer is kept as it is."""
    opened = conflicts.where(F.col("status").isin(*vocab.OPEN)).orderBy(F.desc("penalty_weight"), "id")
    chosen = (opened.limit(limit) if limit is not None else opened).select("id")
    opened = conflicts.join(chosen, "id", "left_semi")
    found = outcomes(opened, adjudicated)
    asked = opened.where("conflict_type = 'ambiguous'").join(found.select("id"), "id", "left_anti")
    answers = model(asked).select("id", F.coalesce("verdict", F.lit("ambiguous")).alias("recommended"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("resolution_paper_id"), F.col("reasons").alias("note"), F.coalesce("weight", F.lit(0.5)).alias("penalty_weight"))
    new = found.unionByName(answers)
    texts = new.select("id", F.nullif(F.left("note", F.lit(ANALYSIS)), F.lit("")).alias("analysis"))
    return resolve(conflicts, new).join(texts, "id", "left")


def view(conflicts: DataFrame, interactions: DataFrame, entities: DataFrame, limit: int = 50, entity: str | None = None) -> DataFrame:
    """Unresolved conflicts with both sides' types and all four names, the heaviest first; of one entity, if given, at either end of the first side."""
    names = entities.select("id", "canonical_name")
    conflicts = conflicts.where(F.col("status").isin(*vocab.UNRESOLVED))
    if entity is not None:
        touching = interactions.where((F.col("entity_a") == entity) | (F.col("entity_b") == entity)).select(F.col("id").alias("interaction_a"))
        conflicts = conflicts.join(touching, "interaction_a", "left_semi")
    out = conflicts.select(F.col("id").alias("conflict"), "interaction_a", "interaction_b", "conflict_type", "penalty_weight")
    for side in ("a", "b"):
        edges = interactions.select(F.col("id").alias(f"interaction_{side}"), F.col("entity_a").alias("left"), F.col("entity_b").alias("right"), F.col("effect").alias(f"effect_{side}"))
        out = out.join(edges, f"interaction_{side}")
        out = out.join(names.select(F.col("id").alias("left"), F.col("canonical_name").alias(f"{side}_left")), "left").join(names.select(F.col("id").alias("right"), F.col("canonical_name").alias(f"{side}_right")), "right").drop("left", "right")
    return out.drop("interaction_a", "interaction_b").orderBy(F.desc("penalty_weight"), "conflict").limit(limit)


def hubs(conflicts: DataFrame, interactions: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """Unresolved conflicts, heaviest first, with the names of the first side."""
    names = entities.select("id", "canonical_name")
    a = interactions.select(F.col("id").alias("interaction_a"), "entity_a", "entity_b", F.col("interaction_type").alias("type_a"))
    b = interactions.select(F.col("id").alias("interaction_b"), F.col("interaction_type").alias("type_b"))
    rows = conflicts.where(F.col("status").isin(*vocab.UNRESOLVED)).join(a, "interaction_a").join(b, "interaction_b")
    rows = rows.join(names.toDF("entity_a", "name_a"), "entity_a").join(names.toDF("entity_b", "name_b"), "entity_b")
    return rows.select("id", "name_a", "name_b", "type_a", "type_b", "conflict_axis", "penalty_weight").orderBy(F.desc("penalty_weight"), "id").limit(limit)


def to_verify(evidence: DataFrame, conflicts: DataFrame, limit: int = 25) -> DataFrame:
    """Evidence on interactions in an unresolved conflict that hasn't been verified, the most confident first."""
    touched = conflicts.where(F.col("status").isin(*vocab.UNRESOLVED)).select(F.explode(F.array("interaction_a", "interaction_b")).alias("interaction_id")).distinct()
    if "verification_status" in evidence.columns:
        unchecked = evidence.where(F.coalesce("verification_status", F.lit("needs_review")) == "needs_review")
    else:
        unchecked = evidence.where((F.col("verification_score").isNull()) | (F.col("verification_score") < 0.3))
    return unchecked.join(touched, "interaction_id", "left_semi").orderBy(F.desc("confidence_score"), "id").select("id", "interaction_id", "confidence_score").limit(limit)


def followups(conflicts: DataFrame, generated: DataFrame) -> DataFrame:
    """Conflicts without follow-up queries become investigating, with the text of one."""
    new = conflicts.where(F.col("status").isin(*vocab.OPEN)).join(generated.select("id"), "id", "left_anti")
    text = F.format_string('conflict_id:%s | "%s" versus "%s" (%s)', "id", "interaction_a", "interaction_b", "conflict_axis")
    return new.select("id", F.lit("investigating").alias("status"), text.alias("query_text"), F.concat(F.lit("conflict_id:"), "id").alias("origin"))
