"""Explicit schemas of the stored tables; creation and migration that can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.sources.sinks import replace
from claimweave.streaming.ingest import _exists

TABLES = {
    "entities": "id string, canonical_name string, display_name string, entity_type string, organism string, external_id string, paper_count long",
    "synonyms": "entity_id string, synonym string, source string",
    "papers": "id string, source string, title string, abstract string, year int, priority int, fetch_status string, extraction_status string, extraction_error string, query_ids array<string>",
    "interactions": "id string, entity_a string, entity_b string, interaction_type string, effect string, direction string, evidence_count long, score double, label string",
    "claims": "claim_id string, paper_id string, line_no long, entity_a_text string, entity_b_text string, interaction_type_text string, direction_text string, effect_text string, evidence_type_text string, confidence_score double, snippet string",
    "evidence": "id string, claim_id string, interaction_id string, paper_id string, evidence_type string, confidence string, confidence_score double, organism string, tissue_cell_type string, condition string, assay_type string, snippet string, verification_status string, verification_score double, verification_notes string, adjudication_score double",
    "conflicts": "id string, interaction_a string, interaction_b string, conflict_axis string, conflict_type string, penalty_weight double, status string, resolution_paper_id string, generated_ids array<string>",
    "searches": "id long, query_text string, source_api string, query_type string, target_kind string, target_id string, generation_reason string, origin string, status string, planning_score double, planning_factors string, papers_new long, new_evidence long, new_interactions long, improved int, last_error string, completed_at timestamp",
    "cache": "entity string, mode string, max_depth int, result string, expires timestamp, hits int",
}


def create(spark: SparkSession, folder: str) -> list[str]:
    """Write the tables that are missing, empty; returns their names."""
    missing = [n for n in TABLES if not _exists(spark, f"{folder}/{n}")]
    for name in missing:
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{folder}/{name}")
    return missing


def migrated(table: DataFrame, name: str) -> DataFrame:
    """The table with the columns of its schema, in order: missing ones null, others cast, columns of its own behind."""
    want = StructType.fromDDL(TABLES[name])
    own = [c for c in table.columns if c not in want.names]
    return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], *own)


def migrate(spark: SparkSession, folder: str) -> list[str]:
    """Bring stored tables to their schemas; returns the names of those that changed."""
    changed = []
    for name in TABLES:
        if _exists(spark, f"{folder}/{name}"):
            old = spark.read.parquet(f"{folder}/{name}")
            new = migrated(old, name)
            if [(f.name, f.dataType) for f in new.schema] != [(f.name, f.dataType) for f in old.schema]:
                replace(new, f"{folder}/{name}")
                changed.append(name)
    return changed
