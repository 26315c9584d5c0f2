"""Connected components by distributed union-find, for edges between rows of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    Rounds of large-star and small-star steps: each links nodes to the least neighbour, so the
    number of rounds grows with the logarithm of a component's diameter. Hot nodes are only ever
    aggregated by their minimum. Each round is written to the shared folder. Null ends are ignored.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    links = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    size = None
    while True:
        ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))  # in each row v is the lesser
        links = materialize(small.where("u > v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # one row
        if now == size:
            break
        size = now
    tree = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = links.select(F.col("v").alias("node")).distinct().join(tree, "node", "left_anti").withColumn("component", F.col("node"))
    return tree.unionByName(roots)
