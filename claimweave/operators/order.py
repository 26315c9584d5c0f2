"""Places of rows in a total order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.session import materialize


def placed(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "place", total: str | None = None) -> DataFrame:
    """The rows with ``name``: their place within their group (null is a group), from 0, in ``order``; and ``total``, the group's size, if named.

    Rows are dealt by ranges of group and order, sorted within each range and written; the rows that
    each range has of a group are counted, and the sums of the ranges before are added. So a group of any size
    is spread over ranges, and only a row for each group and range meets in a window. Rows that are equal in all of
    ``order`` go to one range and take their places in any order: give the order a last column that parts them.
    """
    keys = [F.col(c) for c in group]
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    whole = W.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], "_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    same = part == F.col("_part")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = ranged.join(starts, same)
    return out.select(*rows.columns, (F.col("_base") + F.col("_at") - F.col("_low")).alias(name), *([F.col("_total").alias(total)] if total else []))
