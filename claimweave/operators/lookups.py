"""Search, degree, counts and audits over entities, synonyms and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.functions import vocab


def search(entities: DataFrame, synonyms: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Entities with a synonym that starts with ``prefix``: exact matches first, then by papers; the best synonym of each.

    The prefix is compared as text, so wildcards in it are ordinary characters. A blank one is refused."""
    wanted = prefix.strip().lower()
    if not wanted:
        raise ValueError("an empty search")
    rank = F.when(F.col("synonym") == wanted, 0).otherwise(1)
    hits = synonyms.where(F.col("synonym").startswith(wanted)).groupBy("entity_id").agg(F.min(F.struct(rank.alias("rank"), "synonym")).alias("best"))
    joined = entities.join(hits, entities["id"] == hits["entity_id"]).select("id", "canonical_name", "entity_type", "paper_count", F.col("best.synonym").alias("matching_synonym"), F.col("best.rank").alias("rank"))
    return joined.orderBy("rank", F.desc("paper_count"), "id").limit(min(limit, 50))


def synonym_candidates(entities: DataFrame, synonyms: DataFrame, synonym: str) -> DataFrame:
    hits = synonyms.where(F.col("synonym") == synonym.strip().lower()).select("entity_id").distinct()
    return entities.join(hits, entities["id"] == hits["entity_id"], "left_semi").orderBy(F.desc("paper_count"), "canonical_name", "id")


def endpoints(interactions: DataFrame) -> DataFrame:
    """(entity, interaction) for both ends; a self-loop comes twice."""
    return interactions.select(F.col("entity_a").alias("entity"), "id").unionAll(interactions.select(F.col("entity_b").alias("entity"), "id"))


def degree(interactions: DataFrame) -> DataFrame:
    """Interactions at each entity, a self-loop twice."""
    return endpoints(interactions).groupBy("entity").agg(F.count("*").alias("degree"))


def top_degree(entities: DataFrame, interactions: DataFrame, limit: int) -> DataFrame:
    """Entities by the number of different interactions at them, a self-loop once."""
    counts = endpoints(interactions).distinct().groupBy("entity").agg(F.count("*").alias("degree"))
    return counts.join(entities, counts["entity"] == entities["id"]).select("id", "canonical_name", "degree").orderBy(F.desc("degree"), "id").limit(limit)


def direction_degree(interactions: DataFrame) -> DataFrame:
    """In, out and total degree; a bidirectional interaction counts in both, an undirected one in the total only."""
    way = F.upper("direction")
    forward, back = way.isin("A_TO_B", "BIDIRECTIONAL"), way.isin("B_TO_A", "BIDIRECTIONAL")
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    a = interactions.select(F.col("entity_a").alias("entity"), one(forward).alias("o"), one(back).alias("i"))
    b = interactions.select(F.col("entity_b").alias("entity"), one(back).alias("o"), one(forward).alias("i"))
    return a.unionAll(b).groupBy("entity").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total_degree"))


def sparse_entities(entities: DataFrame, interactions: DataFrame, below: int, limit: int) -> DataFrame:
    counts = degree(interactions).withColumnRenamed("entity", "id")
    joined = entities.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.where(F.col("degree") < below).select("id", "canonical_name", "paper_count", "degree").orderBy(F.desc("paper_count"), "degree", "id").limit(limit)


def low_interaction(entities: DataFrame, interactions: DataFrame, below: int, limit: int) -> DataFrame:
    counts = degree(interactions).withColumnRenamed("entity", "id")
    joined = entities.join(counts, "id", "left").where(F.coalesce("degree", F.lit(0)) < below)
    return joined.select("id", "canonical_name").orderBy("id").limit(limit)


def entity_stats(interactions: DataFrame, evidence: DataFrame | None, conflicts: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """By entity: pieces of evidence on its interactions, and unresolved conflicts whose first side touches it.

    Without ``evidence`` the interactions' own counts are taken. ``sides``: interactions among which all first sides are, if they are fewer."""
    ends = lambda rows, *more: rows.select(F.explode(F.array_distinct(F.array("entity_a", "entity_b"))).alias("entity"), *more).where("entity IS NOT NULL")
    if evidence is not None:
        sizes = evidence.groupBy("interaction_id").agg(F.count("*").alias("evidence_count"))
        interactions = interactions.drop("evidence_count").join(sizes, F.col("id") == F.col("interaction_id"))
    total = ends(interactions, "evidence_count").groupBy("entity").agg(F.sum("evidence_count").alias("evidence_total"))
    opened = conflicts.where(F.col("status").isin(*vocab.UNRESOLVED)).groupBy(F.col("interaction_a").alias("id")).agg(F.count("*").alias("n"))
    clashes = ends((interactions if sides is None else sides).join(opened, "id"), "n").groupBy("entity").agg(F.sum("n").alias("open_conflicts"))
    return total.join(clashes, "entity", "left").withColumn("open_conflicts", F.coalesce("open_conflicts", F.lit(0)))


def synonym_overlaps(entities: DataFrame, synonyms: DataFrame, limit: int = 50) -> DataFrame:
    """Synonyms of several entities: how many, which ids and types, and their papers."""
    joined = synonyms.join(entities, synonyms["entity_id"] == entities["id"])
    groups = joined.groupBy("synonym").agg(
        F.count_distinct("id").alias("n_entities"), F.sort_array(F.collect_set("id")).alias("ids"), F.sort_array(F.collect_set("entity_type")).alias("types"), F.sum("paper_count").alias("total_paper_count")
    )
    shared = groups.where("n_entities > 1")
    return shared.orderBy(F.desc("n_entities"), F.desc("total_paper_count"), "synonym").limit(limit).withColumns({"ids": F.array_join("ids", ","), "types": F.array_join("types", ",")})


def overlap_total(synonyms: DataFrame) -> DataFrame:
    return synonyms.groupBy("synonym").agg(F.count_distinct("entity_id").alias("n")).where("n > 1").agg(F.count("*").alias("overlapping_synonyms"))


def effect_histogram(interactions: DataFrame) -> DataFrame:
    effect = F.lower(F.trim(F.coalesce("effect", F.lit("")))).alias("effect")
    return interactions.groupBy(effect).agg(F.count("*").alias("n"), F.max(vocab.sign(F.col("effect"))).alias("sign"), F.max(vocab.is_mapped(F.col("effect"))).alias("mapped"))


def unmapped_effects(effects: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent effects that no vocabulary has."""
    key = F.lower(F.trim(F.coalesce("effect", F.lit("")))).alias("effect")
    return effects.where(~vocab.is_mapped(F.col("effect"))).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "effect").limit(limit)


def stats_bundle(entities: DataFrame, interactions: DataFrame, evidence: DataFrame, papers: DataFrame, conflicts: DataFrame, penalty: float = 1.0, metrics: DataFrame | None = None) -> DataFrame:
    """One row of counts, conflicts by status, and the cycle score; with ``metrics`` (cycle, score, timestamp) those of the last cycle, null if there was none."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    clash = conflicts.agg(
        F.count_if(F.col("status").isin(*vocab.OPEN)).alias("open_conflicts"),
        F.count_if(F.col("status") == "resolved").alias("resolved_conflicts"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*vocab.UNRESOLVED), F.col("penalty_weight"))), F.lit(0.0)).alias("conflict_weight"),
    )
    key = F.lit(1).alias("one")
    out = count(entities, "entities").select("*", key)
    for df in (count(interactions, "interactions"), count(evidence, "evidence"), count(papers, "papers"), clash):
        out = out.join(df.select("*", key), "one")
    score = F.col("entities").cast("double") * F.col("interactions") / (1 + penalty * F.col("conflict_weight"))
    out = out.withColumn("score", F.round(score, 4))
    if metrics is not None:
        last = metrics.agg(F.max_by("score", "cycle").alias("last_score"), F.max_by("timestamp", "cycle").alias("last_cycle_timestamp"))
        out = out.join(last.select("*", key), "one")
    return out.drop("one")


def star(evidence: DataFrame, interactions: DataFrame, papers: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence with its interaction's score, its paper's year and both names."""
    a, b = entities.select(F.col("id").alias("entity_a"), F.col("canonical_name").alias("name_a")), entities.select(F.col("id").alias("entity_b"), F.col("canonical_name").alias("name_b"))
    edges = interactions.select(F.col("id").alias("interaction_id"), F.col("score").alias("composite_score"), "label")
    years = papers.select(F.col("id").alias("paper_id"), F.col("year").alias("paper_year"))
    return evidence.join(edges, "interaction_id").join(years, "paper_id").join(a, "entity_a").join(b, "entity_b")


def drawer(evidence: DataFrame, papers: DataFrame, interaction_id: str) -> DataFrame:
    """The evidence of one interaction, with its papers, best first."""
    rows = evidence.where(F.col("interaction_id") == interaction_id)
    joined = rows.join(papers.select(F.col("id").alias("paper_id"), "priority", "status"), "paper_id")
    return joined.select("id", "paper_id", "year", "priority", "status", "evidence_type", "confidence_score").orderBy(F.desc("confidence_score"), "id")


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; none if it is missing or the value is null."""
    return table.where(F.col(key) == F.lit(value))


def optional(table: DataFrame, **wanted) -> DataFrame:
    """The rows with these values; a value of None is no filter."""
    for column, value in wanted.items():
        table = table if value is None else table.where(F.col(column) == value)
    return table


def visible_edges(edges: DataFrame, show_unknown: bool = False) -> DataFrame:
    """Edges that a picture shows: those of a known, unambiguous effect, or all."""
    return edges if show_unknown else edges.where(F.col("effect").isNotNull() & ~F.col("effect").isin("unknown", "ambiguous"))


def pending_queries(searches: DataFrame, limit: int) -> DataFrame:
    return searches.where("status = 'pending'").orderBy(F.desc_nulls_last("planning_score"), "completed_at", "id").limit(limit)


def pending_candidates(searches: DataFrame, per_cycle: int) -> DataFrame:
    """The oldest pending searches, from which a cycle's are chosen."""
    return searches.where("status = 'pending'").orderBy("completed_at", "id").limit(max(100, 5 * per_cycle))


def conflict_queue(conflicts: DataFrame, limit: int = 10, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Conflicts of a status and type, if given, the heaviest first."""
    return optional(conflicts, status=status, conflict_type=kind).orderBy(F.desc("penalty_weight"), "id").limit(limit)


def open_conflicts(conflicts: DataFrame, limit: int) -> DataFrame:
    return conflicts.where(F.col("status").isin(*vocab.OPEN)).orderBy(F.desc("penalty_weight"), "id").limit(limit)


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The row of the greatest ``order``; no row of none."""
    return rows.orderBy(F.desc(order)).limit(1)


def names_of_type(entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    return optional(entities, entity_type=entity_type).select("id", "canonical_name")


def synonym_detail(entities: DataFrame, synonyms: DataFrame, limit: int = 50) -> DataFrame:
    """The entities of the synonyms that synonym_overlaps() names, most papers first."""
    shared = synonym_overlaps(entities, synonyms, limit).select("synonym")
    joined = synonyms.join(F.broadcast(shared), "synonym").join(entities, synonyms["entity_id"] == entities["id"])  # limit rows
    return joined.select("synonym", "id", "canonical_name", "entity_type", "paper_count")


def resolved_names(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, entity_id, status) of names for graph calls: ok where exactly one entity has the name as a synonym, else missing or ambiguous."""
    key = F.lower(F.trim("name"))
    counts = synonyms.groupBy("synonym").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
    rows = names.select("name", key.alias("synonym")).join(counts, "synonym", "left")
    status = F.when(F.col("low").isNull(), "missing").when(F.col("low") != F.col("high"), "ambiguous").otherwise("ok")
    return rows.select("name", F.when(status == "ok", F.col("low")).alias("entity_id"), status.alias("status"))


class NameNotFound(LookupError):
    """No entity has the name."""


class AmbiguousName(LookupError):
    """Several entities have the name."""


def entity_of(synonyms: DataFrame, name: str, strict: bool = True) -> str | None:
    """The id of the one entity of a name. Without one, an error that says why, or None if not ``strict``."""
    ids = [r["entity_id"] for r in synonyms.where(F.col("synonym") == name.strip().lower()).select("entity_id").distinct().limit(2).collect()]
    if len(ids) == 1:
        return ids[0]
    if strict:
        raise AmbiguousName(name) if ids else NameNotFound(name)
    return None


def different_ends(source: str, target: str) -> None:
    if source == target:
        raise ValueError("a path needs two different entities")


def path_nodes(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, place, id, name, entity_type) of the nodes of paths; the name shown is the display name, else the canonical one."""
    shown = F.coalesce(F.nullif("display_name", F.lit("")), "canonical_name") if "display_name" in entities.columns else F.col("canonical_name")
    nodes = paths.select("path", F.posexplode(F.split("path", ">")).alias("place", "id"))
    return nodes.join(entities.select("id", shown.alias("name"), "entity_type"), "id").select("path", "place", "id", "name", "entity_type")


def strongest_affected(affected: DataFrame, limit: int = 10) -> DataFrame:
    """The affected entities of each seed and mode by the size of their score, then id: ``limit`` of each."""
    w = W.partitionBy("seed", "mode").orderBy(F.desc(F.abs("score")), "target")
    return affected.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("seed", "mode", "place", "target", "score")
