"""Graph exports and table writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"high": 3, "medium": 2, "low": 1}


def rank(label: Column) -> Column:
    return F.when(label == "high", 3).when(label == "medium", 2).otherwise(1)


def export_edges(interactions: DataFrame, evidence: DataFrame, least: str = "low", fewest: int = 1) -> DataFrame:
    """Edges of at least a label and number of pieces of evidence, each with its evidence as a sorted list."""
    kept = interactions.where((rank(F.col("label")) >= RANK.get(least, 1)) & (F.col("evidence_count") >= fewest))
    lists = evidence.groupBy("interaction_id").agg(F.array_sort(F.collect_list(F.struct("id", "paper_id", "evidence_type", "confidence_score"))).alias("evidence"))
    return kept.join(lists.withColumnRenamed("interaction_id", "id"), "id", "left")


def write_json(entities: DataFrame, edges: DataFrame, conflicts: DataFrame, folder: str) -> None:
    entities.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")
    conflicts.where("status = 'open'").write.mode("overwrite").json(f"{folder}/conflicts")


def xml_text(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def graphml(entities: DataFrame, interactions: DataFrame) -> DataFrame:
    """(part, id, line): a GraphML document line by line, in order of part and id; values are escaped."""
    nodes = entities.select(F.lit(1).alias("part"), "id", F.format_string('<node id="%s"><data key="name">%s</data><data key="type">%s</data></node>', xml_text(F.col("id")), xml_text(F.col("canonical_name")), xml_text(F.col("entity_type"))).alias("line"))
    edges = interactions.select(F.lit(2).alias("part"), "id", F.format_string('<edge source="%s" target="%s"><data key="effect">%s</data><data key="confidence">%s</data></edge>', xml_text(F.col("entity_a")), xml_text(F.col("entity_b")), xml_text(F.col("effect")), xml_text(F.col("label"))).alias("line"))
    return nodes.unionAll(edges)


def write_graphml(lines: DataFrame, folder: str) -> None:
    """Sorted part files; concatenated between a header and a footer they make the document."""
    lines.orderBy("part", "id").select("line").write.mode("overwrite").text(folder)


def append(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def replace(rows: DataFrame, folder: str) -> None:
    """Overwrite a table that ``rows`` may have been read from: written beside it first, so that a failure leaves the old one."""
    spark = rows.sparkSession
    staged = f"{folder}.staged"
    rows.write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(folder)


def reset(tables: dict[str, DataFrame], folder: str, hard: bool = False, keep: tuple[str, ...] = ("entities", "synonyms")) -> None:
    """Empty the tables under ``folder``: all of them, or all but ``keep``."""
    for name, df in tables.items():
        if hard or name not in keep:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{folder}/{name}")  # nothing is read from what is overwritten
