"""The whole cycle over a batch of claims, as one job of foreachBatch with one marker at its end.

Names are resolved or become entities; claims are kept as their texts have them; new evidence is stored once for
an interaction and paper; scores, conflicts and counts follow for what the batch touches; conflicts are
analysed, searches planned, and a row of metrics added. Interactions, evidence and conflicts are dealt by the pair of their
entities and the interaction's type, within which all conflicts lie: so a batch reads and writes
only the buckets of the pairs that it has. Until the marker is written, readers see the tables as they were; a batch that is replayed
after any break gives the same tables as one without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.config import Config
from claimweave.functions import vocab
from claimweave.operators import confidence, conflicts, lookups, planner, resolve, writes
from claimweave.operators.confidence import EDGE
from claimweave.operators.loads import interaction_key
from claimweave.session import materialize
from claimweave.sources.buckets import Tables
from claimweave.streaming.ingest import new_evidence

#: A batch's claims, with names in place of entities; types and organisms of names may be null.
CLAIMS = (
    "entity_a string, entity_b string, type_a string, type_b string, interaction_type string, effect string, direction string, paper_id string, line_no int, evidence_type string, confidence_score double, "
    "verification_score double, snippet string, year int, organism string, tissue_cell_type string, condition string"
)
_EDGE = ", ".join(f"{c} string" for c in EDGE)
SCHEMAS = {
    "entities": "id string, canonical_name string, entity_type string, organism string, paper_count long",
    "synonyms": "entity_id string, synonym string",
    "claims": "claim_id string, paper_id string, line_no int, entity_a_text string, entity_b_text string, interaction_type_text string, direction_text string, effect_text string, evidence_type_text string, confidence_score double, snippet string",
    "evidence": f"id string, interaction_id string, pair string, {_EDGE}, paper_id string, line_no int, evidence_type string, confidence_score double, verification_score double, snippet string, year int, organism string, tissue_cell_type string, condition string, "
    "norm_organism string, norm_tissue string, norm_condition string, adjudication_score double, note string",
    "interactions": f"id string, pair string, {_EDGE}, evidence_count long, weighted double, weight double, score double, label string",
    "conflicts": "id string, interaction_a string, interaction_b string, pair string, conflict_axis string, conflict_type string, penalty_weight double, status string, resolution_paper_id string, analysis string",
    "searches": "id string, origin string, reason string, query_text string, planning_score double, status string",
    "metrics": "cycle int, papers long, new_entities long, new_interactions long, new_evidence long, new_conflicts long, conflicts_reopened long, conflicts_resolved long, queries_generated long, entities long, interactions long, evidence long, open_conflicts long, conflict_weight double, score double",
}
KEYS = {"entities": "id", "synonyms": "synonym", "evidence": "pair", "interactions": "pair", "conflicts": "pair", "searches": "id"}


def tables(spark: SparkSession, folder: str, buckets: int = 16) -> Tables:
    return Tables(spark, folder, SCHEMAS, KEYS, buckets)


def pair_of(a: str = "entity_a", b: str = "entity_b", kind: str = "interaction_type") -> Column:
    """The same for both directions of two entities."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b), F.coalesce(kind, F.lit("")))


def _mention(side: str) -> Column:
    return F.concat_ws("\x1f", F.coalesce(f"type_{side}", F.lit("unknown")), F.coalesce("organism", F.lit("")), F.trim(f"entity_{side}"))


def resolve_names(t: Tables, batch: DataFrame, settings: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The batch with ids of entities in place of names; new entities; new synonyms."""
    ends = [batch.select(_mention(s).alias("mention"), F.trim(f"entity_{s}").alias("name"), F.coalesce(f"type_{s}", F.lit("unknown")).alias("entity_type"), "organism") for s in ("a", "b")]
    mentions = materialize(ends[0].unionByName(ends[1]).where("name != ''").dropDuplicates(["mention"]), "mentions")
    entities, synonyms = t.read("entities"), t.read("synonyms")
    found = materialize(resolve.cascade(mentions, entities, synonyms, least=settings.fuzzy_ratio), "resolved")
    new, names = resolve.created(mentions, found)
    learned = resolve.learn_synonyms(found, mentions, synonyms)
    ids = found.select("mention", "entity_id")
    rows = batch.withColumns({"_a": _mention("a"), "_b": _mention("b")})
    rows = rows.join(ids.toDF("_a", "_ia"), "_a").join(ids.toDF("_b", "_ib"), "_b").withColumns({"entity_a": F.col("_ia"), "entity_b": F.col("_ib")}).drop("_a", "_b", "_ia", "_ib")
    return rows, new, names.unionByName(learned).distinct()


def run_batch(t: Tables, batch: DataFrame, n: int, settings: Config | None = None, model: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Take batch ``n`` of claims into the tables; nothing if its marker is there. ``model`` gives types to ambiguous conflicts (see conflicts.analyse)."""
    if n <= t.last:
        return
    settings = settings or Config()
    batch = materialize(batch, "batch")
    rows, created, names = resolve_names(t, batch, settings)
    rows = rows.withColumns({"interaction_id": interaction_key(*EDGE), "pair": pair_of()})
    rows, created = materialize(rows, "claims"), materialize(created, "created")
    t.put(n, "claims", writes.literal_claims(batch), [])

    # names and counts of papers
    papers = rows.select("paper_id", F.explode(F.array("entity_a", "entity_b")).alias("id"))
    at_entities = t.touched(papers.select("id").unionByName(created.select("id")), "id")
    known = materialize(writes.paper_counts(rows, t.read("entities", at_entities).unionByName(created.withColumn("paper_count", F.lit(0).cast("long")))), "entities")
    t.put(n, "entities", known, at_entities)
    at = t.touched(names, "synonym")
    t.put(n, "synonyms", t.read("synonyms", at).unionByName(names).distinct(), at)

    # evidence and scores of what is touched
    at = t.touched(rows, "pair")
    before = t.read("evidence", at)
    fresh = new_evidence(rows, before).withColumn("id", F.concat_ws("@", "interaction_id", "paper_id"))
    fresh = materialize(confidence.adjudicate(confidence.with_contexts(fresh)).select(*before.columns), "fresh")
    evidence = materialize(before.unionByName(fresh), "evidence")
    t.put(n, "evidence", evidence, at)
    old = t.read("interactions", at).drop("score", "label")
    edges = materialize(confidence.scored(confidence.merged(old, confidence.sums(fresh, "pair"), "pair")), "interactions")
    t.put(n, "interactions", edges, at)

    # conflicts within the pairs that got evidence, then the analysis of the heaviest of all
    changed = fresh.select(F.col("interaction_id").alias("id")).distinct()
    pairs = fresh.select("pair").distinct()
    stored = t.read("conflicts", at)
    reopened = conflicts.reopen(stored, changed)
    found = conflicts.detect(edges.join(pairs, "pair", "left_semi"), evidence.join(pairs, "pair", "left_semi"), stored)
    ends = edges.select(F.col("id").alias("interaction_a"), "pair")
    found = materialize(found.join(ends, "interaction_a").withColumns({"resolution_paper_id": F.lit(None).cast("string"), "analysis": F.lit(None).cast("string")}), "found")
    mine = materialize(reopened.unionByName(found.select(*stored.columns)), "conflicts")
    rest = [b for b in range(t.buckets) if b not in at]
    every = mine.unionByName(t.read("conflicts", rest))
    heaviest = materialize(lookups.open_conflicts(every, settings.conflicts_per_cycle), "heaviest")
    sides = heaviest.select(F.explode(F.array("interaction_a", "interaction_b")).alias("interaction_id"), "pair")
    theirs = t.touched(heaviest, "pair")
    grounds = evidence.unionByName(t.read("evidence", [b for b in theirs if b not in at])).join(sides.select("interaction_id").distinct(), "interaction_id", "left_semi")
    nothing = lambda asked: asked.select("id", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("reasons")).limit(0)
    judged = materialize(conflicts.analyse(heaviest.drop("analysis"), materialize(grounds, "grounds"), model or nothing), "analysed")
    already = t.read("searches").where("origin LIKE 'conflict_id:%'").select(F.expr("substring(origin, 13)").alias("id"))
    asked = materialize(conflicts.followups(judged, already), "followups")
    judged = judged.join(asked.select("id", F.col("status").alias("_new")), "id", "left").withColumn("status", F.coalesce("_new", "status"))
    judged = judged.join(heaviest.select("id", F.col("analysis").alias("_old")), "id").withColumn("analysis", F.coalesce("analysis", "_old"))
    judged = materialize(judged.select(*stored.columns), "judged")
    both = sorted({*at, *theirs})
    after = mine.unionByName(t.read("conflicts", [b for b in theirs if b not in at])).join(judged.select("id"), "id", "left_anti").unionByName(judged)
    t.put(n, "conflicts", after, both)

    # searches for the next cycle, and what this one brought
    families = planner.allocate({"conflict": 1.0, "entity": 1.0, "interaction": 1.0}, settings.targeted_per_cycle)
    entities = known.unionByName(t.read("entities", [b for b in range(t.buckets) if b not in at_entities]))
    all_edges = edges.unionByName(t.read("interactions", rest))
    all_evidence = evidence.unionByName(t.read("evidence", rest))
    planned = materialize(planner.targeted(every.join(judged.select("id"), "id", "left_anti").unionByName(judged), all_edges, entities, families, all_evidence), "targeted")
    planned = planned.unionByName(asked.select("origin", F.lit("conflict_follow_up").alias("reason"), "query_text", F.lit(2.0).alias("planning_score")))
    planned = planned.withColumns({"id": F.sha2(F.concat_ws("\x1f", "origin", "reason"), 256), "status": F.lit("pending")})
    planned = materialize(resolve.insert_if_absent(t.read("searches"), planned, ["id"]), "planned")
    at_searches = t.touched(planned, "id")
    t.put(n, "searches", t.read("searches", at_searches).unionByName(planned.select(*t.read("searches").columns)), at_searches)
    t.put(n, "metrics", metrics(n, batch, created, fresh, old, stored, found, mine, heaviest, judged, planned, entities, all_edges, every, settings), [])
    t.commit(n)


def metrics(n, batch, created, fresh, old_edges, old_conflicts, found, mine, heaviest, judged, planned, entities, edges, conflict_rows, settings) -> DataFrame:
    """One row: what the batch brought, and how the graph stands."""
    unresolved = conflict_rows.join(judged.select("id"), "id", "left_anti").unionByName(judged)
    new_edges = fresh.select(F.col("interaction_id").alias("id")).distinct().join(old_edges.select("id"), "id", "left_anti")
    back = mine.where("status = 'reopened'").join(old_conflicts.where("status != 'reopened'").select("id"), "id", "left_semi")
    brought = {"papers": batch.select("paper_id").distinct(), "new_entities": created, "new_interactions": new_edges, "new_evidence": fresh, "new_conflicts": found, "conflicts_reopened": back}
    brought |= {"conflicts_resolved": judged.where("status = 'resolved'"), "queries_generated": planned, "entities": entities}
    row = edges.agg(F.count("*").alias("interactions"), F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence"), F.lit(n).alias("cycle"))
    weight = F.coalesce(F.sum(F.when(F.col("status").isin(*vocab.UNRESOLVED), F.col("penalty_weight"))), F.lit(0.0)).alias("conflict_weight")
    row = row.join(unresolved.agg(F.count_if(F.col("status").isin(*vocab.OPEN)).alias("open_conflicts"), weight, F.lit(n).alias("cycle")), "cycle")
    for name, rows in brought.items():
        row = row.join(rows.agg(F.count("*").alias(name), F.lit(n).alias("cycle")), "cycle")  # one row each
    return row.withColumn("score", F.round(F.col("entities").cast("double") * F.col("interactions") / (1 + settings.penalty * F.col("conflict_weight")), 4))


def stream(spark: SparkSession, source: str, folder: str, settings: Config | None = None, model: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1, buckets: int = 16) -> StreamingQuery:
    """Take in claim files from a folder in micro-batches, all that is there, then stop."""
    claims = spark.readStream.schema(CLAIMS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = claims.writeStream.foreachBatch(lambda batch, n: run_batch(tables(spark, folder, buckets), batch, n, settings, model))
    return writer.option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
