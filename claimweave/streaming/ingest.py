"""Incremental ingest: micro-batches of claims into the evidence table, and metrics by cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.operators.confidence import composite
from claimweave.sources.sinks import append


def new_evidence(claims: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """The first claim of each interaction and paper that isn't stored yet."""
    w = W.partitionBy("interaction_id", "paper_id").orderBy("line_no", F.desc("confidence_score"))
    first = claims.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return first if evidence is None else first.join(evidence.select("interaction_id", "paper_id"), ["interaction_id", "paper_id"], "left_anti")


def run_cycle(spark: SparkSession, batch: DataFrame, cycle: int, folder: str) -> None:
    """Store a batch: all claims, new evidence, and one row of metrics, last. A cycle with metrics isn't stored again; one that
    broke off before may leave claims twice, each with its cycle."""
    table = lambda name: spark.read.parquet(f"{folder}/{name}") if _exists(spark, f"{folder}/{name}") else None
    metrics = table("metrics")
    if metrics is not None and not metrics.where(F.col("cycle") == cycle).isEmpty():
        return
    append(batch.withColumn("cycle", F.lit(cycle)), f"{folder}/claims")
    fresh = new_evidence(batch, table("evidence"))
    append(fresh.withColumn("cycle", F.lit(cycle)), f"{folder}/evidence")
    stored = table("evidence")
    edges = composite(stored)
    row = edges.agg(F.count("*").alias("interactions"), F.sum("evidence_count").alias("evidence"), F.round(F.avg("score"), 6).alias("mean_score"))
    append(row.withColumn("cycle", F.lit(cycle)), f"{folder}/metrics")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ingest(spark: SparkSession, source: str, schema: str, folder: str, files_per_batch: int = 1) -> StreamingQuery:
    """Stream claim files from a folder; all that is there, in micro-batches, then stop."""
    claims = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = claims.writeStream.foreachBatch(lambda batch, n: run_cycle(batch.sparkSession, batch, n, folder))
    return writer.option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()


def outcome_stream(events: DataFrame, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Searches by day and type, with their yields; rows later than ``late`` are left out when this runs as a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", span).alias("w"), "event_type").agg(F.count("*").alias("searches"), F.round(F.sum("value"), 4).alias("total_value")).select(F.col("w.start").alias("day"), "event_type", "searches", "total_value")
