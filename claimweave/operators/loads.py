"""Curated loads: records of interaction files become interactions, evidence and virtual papers; accessions become entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.sources.tabular import accession

EDGE = ("entity_a", "entity_b", "interaction_type", "effect", "direction")
SNIPPET = 400


def interaction_key(*columns: str) -> Column:
    """The id of an interaction: its five columns, null written as nothing between two marks of its own."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def get_or_create(asked: DataFrame, cached: DataFrame, synonyms: DataFrame, external: DataFrame, entries: DataFrame) -> DataFrame:
    """(accession, entity_id, how) of accessions, null where nothing is known.

    In turn: ``cached`` (accession, entity_id), a synonym that is the accession, an entity's external id
    (``external``: accession, entity_id), and a new entity from ``entries`` (accession, canonical_name). An isoform is its main accession."""
    rows = asked.select("accession", accession(F.col("accession")).alias("main"))
    sources = {
        "cache": cached.select(F.col("accession").alias("main"), "entity_id"),
        "synonym": synonyms.select(F.upper("synonym").alias("main"), "entity_id"),
        "external": external.select(F.col("accession").alias("main"), "entity_id"),
        "created": entries.select(F.col("accession").alias("main"), F.concat(F.lit("new:"), "accession").alias("entity_id")),
    }
    for how, known in sources.items():
        rows = rows.join(known.groupBy("main").agg(F.min("entity_id").alias(how)), "main", "left")
    first = F.coalesce(*[F.when(F.col(how).isNotNull(), how) for how in sources])
    return rows.select("accession", F.coalesce(*sources).alias("entity_id"), first.alias("how"))


def psi_mitab_records(parsed: DataFrame) -> DataFrame:
    """Records of pathway lines, ready for load(): a fixed score, the pathway as paper."""
    snippet = F.format_string("Reactome pathway %s: %s %s %s", "pathway_id", "acc_a", "mi_label", "acc_b")
    return _records(parsed, F.concat(F.lit("reactome:"), "pathway_id"), "reactome", F.concat(F.lit("Reactome pathway "), "pathway_id"), F.lit(0.75), F.lit("high"), snippet, F.lit(None).cast("string"), "Reactome")


def entry_records(parsed: DataFrame) -> DataFrame:
    """Records of entries' interactions: undirected direct binding, scored by experiments."""
    rows = parsed.withColumns({"interaction_type": F.lit("direct_binding"), "effect": F.lit("binds"), "direction": F.lit("undirected")})
    title = F.format_string("IntAct curated interaction: %s / %s", "acc_a", "acc_b")
    snippet = F.format_string("IntAct binary interaction: %s / %s (%s experiment(s))", "acc_a", "acc_b", F.col("experiments").cast("string"))
    return _records(rows, F.concat(F.lit("uniprot:"), "record"), "uniprot", title, F.col("score"), F.col("label"), snippet, F.lit(None).cast("string"), "IntAct")


def signed_file_records(parsed: DataFrame) -> DataFrame:
    """Records of signed lines: each with its own score and its record as paper."""
    title = F.format_string("SIGNOR curated interaction %s: %s %s %s", "record", "acc_a", "mechanism", "acc_b")
    snippet = F.format_string("SIGNOR %s: %s %s %s via %s", "record", "acc_a", "raw_effect", "acc_b", "mechanism")
    return _records(parsed, F.concat(F.lit("signor:"), "record"), "signor", title, F.col("score"), F.col("label"), snippet, F.col("context"), "SIGNOR")


def _records(rows: DataFrame, paper: Column, source: str, title: Column, score: Column, label: Column, snippet: Column, tissue: Column, assay: str) -> DataFrame:
    return rows.select("acc_a", "acc_b", *EDGE[2:], paper.alias("paper_id"), F.lit(source).alias("source"), title.alias("title"), score.alias("confidence_score"), label.alias("confidence"), F.left(snippet, F.lit(SNIPPET)).alias("snippet"), tissue.alias("tissue_cell_type"), F.lit(assay).alias("assay_type"))


def placed(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with entity_a and entity_b, from ``ids`` (accession, entity_id), and their interaction; those with an unknown end go."""
    rows = records.join(ids.toDF("acc_a", "entity_a"), "acc_a").join(ids.toDF("acc_b", "entity_b"), "acc_b")
    return rows.withColumn("interaction_id", interaction_key(*EDGE))


def new_papers(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Virtual papers that aren't known: done, without text, so that extraction never takes them. Of several titles the first."""
    every = rows.groupBy(F.col("paper_id").alias("id")).agg(F.min("source").alias("source"), F.min("title").alias("title"))
    status = {"fetch_status": F.lit("abstract_only"), "extraction_status": F.lit("done"), "abstract": F.lit(None).cast("string")}
    return every.join(papers.select("id"), "id", "left_anti").withColumns(status)


def new_interactions(rows: DataFrame, interactions: DataFrame) -> DataFrame:
    known = interactions.select(interaction_key(*EDGE).alias("interaction_id"))
    return rows.select("interaction_id", *EDGE).distinct().join(known, "interaction_id", "left_anti")


def new_evidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """One piece of curated evidence for each interaction and paper that has none: the best scored record, then the first snippet."""
    fields = ["confidence_score", "confidence", "snippet", "tissue_cell_type", "assay_type"]
    best = F.min(F.struct((-F.col("confidence_score")).alias("low"), F.col("snippet").alias("by"), F.struct(*fields).alias("own"))).alias("x")
    first = rows.groupBy("interaction_id", "paper_id").agg(best).select("interaction_id", "paper_id", "x.own.*")
    fixed = {"evidence_type": F.lit("curated_db"), "organism": F.lit("Homo sapiens")}
    return first.join(evidence.select("interaction_id", "paper_id"), ["interaction_id", "paper_id"], "left_anti").withColumns(fixed)
