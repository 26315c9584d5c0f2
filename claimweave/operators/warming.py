"""The cache of propagation results: warmed in batches, answered from, counted and logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators import graph
from claimweave.session import materialize

HOURS = 24


def _runs(asked: DataFrame) -> DataFrame:
    sign = F.when(F.col("mode") == "suppress", -1.0).otherwise(1.0)
    return asked.select(F.concat_ws(":", "seed", "mode").alias("run"), F.col("seed").alias("entity"), sign.alias("score"))


def _named(found: DataFrame) -> DataFrame:
    mode = F.substring_index("run", ":", -1)
    return found.select(F.expr("left(run, length(run) - length(substring_index(run, ':', -1)) - 1)").alias("seed"), mode.alias("mode"), "target", "score", "hop")


def store(cache: DataFrame, contributions: DataFrame, fresh: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cache and contributions with those of the requests ``fresh`` (seed, mode, max_depth, expires) replaced by what was ``found``; their hits start anew."""
    done = fresh.select("seed", "mode")
    rows = cache.join(done, ["seed", "mode"], "left_anti").unionByName(fresh.withColumn("hits", F.lit(0).cast("long")))
    return rows, contributions.join(done, ["seed", "mode"], "left_anti").unionByName(found)


def warm(top: DataFrame, cache: DataFrame, contributions: DataFrame, edges: DataFrame, depth: int, now: Column, modes: tuple[str, ...] = ("suppress", "promote"), hours: int = HOURS) -> tuple[DataFrame, DataFrame]:
    """The cache (seed, mode, max_depth, expires, hits) and its contributions (seed, mode, target, score, hop) after a warm-up of the entities
    ``top`` (id): what isn't there, is expired or isn't as deep is computed, all in one loop, and kept for ``hours``."""
    missing = materialize(graph.to_warm(top, cache, depth, now, modes), "missing")
    found = _named(graph.arrivals(materialize(edges, "arcs"), _runs(missing), depth)[0])
    fresh = missing.withColumns({"max_depth": F.lit(depth), "expires": now + F.make_interval(hours=F.lit(hours))})
    return store(cache, contributions, fresh, materialize(found, "found"))


def count_hits(cache: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The cache with the hits of each row raised by the number of requests (seed, mode, depth) that it answers."""
    fits = asked.join(cache.select("seed", "mode", "max_depth", "expires"), ["seed", "mode"]).where((F.col("expires") > now) & (F.col("depth") <= F.col("max_depth")))
    more = fits.groupBy("seed", "mode").agg(F.count("*").alias("more"))
    return cache.join(more, ["seed", "mode"], "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more")


def log_rows(asked: DataFrame, answers: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """(entity_name, mode, depth, result_count, created_at) of the requests (seed, mode, depth), for the query log; requests without a result count 0."""
    sizes = answers.groupBy("seed", "mode").agg(F.count("*").alias("result_count"))
    rows = asked.join(sizes, ["seed", "mode"], "left").join(names.select(F.col("id").alias("seed"), F.col("canonical_name").alias("entity_name")), "seed", "left")
    return rows.select("entity_name", "mode", "depth", F.coalesce("result_count", F.lit(0)).alias("result_count"), now.alias("created_at"))
