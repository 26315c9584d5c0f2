"""Change from one cycle to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def score_history(cycles: DataFrame, penalty: float = 1.0) -> DataFrame:
    """By cycle (cycle, entities, interactions, conflict_weight): its score, and the change from the cycle before. A row a cycle."""
    score = F.col("entities").cast("double") * F.col("interactions") / (1 + penalty * F.col("conflict_weight"))
    rows = cycles.select("cycle", F.round(score, 4).alias("score"))
    return rows.withColumn("change", F.round(F.col("score") - F.lag("score").over(W.orderBy("cycle")), 4))


def gains(events: DataFrame) -> DataFrame:
    """By day: searches, and how many more than on the day before. The window is over one row a day."""
    days = events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("searches"))
    return days.withColumn("gained", F.col("searches") - F.lag("searches").over(W.orderBy("day")))
