"""Graph queries as bounded loops of joins, a column of ranks in place of queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import vocab
from claimweave.functions.numbers import exact_round
from claimweave.operators.order import placed
from claimweave.session import materialize

ALPHA = 0.55


def arcs(interactions: DataFrame, entities: DataFrame, least: float = 0.0) -> DataFrame:
    """(source, target, branch, id, effect, sign, score): directed arcs to known entities, of at least a score.

    A bidirectional interaction gives an arc each way. A null score is 0."""
    way, score = F.upper("direction"), F.coalesce("score", F.lit(0.0))
    cols = ["id", "effect", vocab.sign(F.col("effect")).alias("sign"), score.alias("score")]
    ahead = interactions.where(way.isin("A_TO_B", "BIDIRECTIONAL")).select(F.col("entity_a").alias("source"), F.col("entity_b").alias("target"), F.lit(0).alias("branch"), *cols)
    back = interactions.where(way.isin("B_TO_A", "BIDIRECTIONAL")).select(F.col("entity_b").alias("source"), F.col("entity_a").alias("target"), F.lit(1).alias("branch"), *cols)
    out = ahead.unionAll(back).where(F.col("score") >= least)
    return out.join(entities.select(F.col("id").alias("target")), "target", "left_semi")


def arrivals(edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(run, target, id, score, hop, sign) of every arrival, and (run, source, id) of excluded arcs.

    ``seeds``: (run, entity, score). All runs go in one loop of ``depth`` joins. Nodes are expanded
    once, with the score of their first arrival: in each hop by the parent's rank, then branch,
    then id, which is the order of a queue. Ranks are given by ranges, so a run's frontier is spread over tasks; arcs of a
    hub are split as a skewed join. Arcs of sign 0 are excluded; arcs into a run's seed are dropped."""
    start = seeds.select("run", F.col("entity").alias("seed"))
    frontier = seeds.select("run", F.col("entity").alias("source"), F.col("score").alias("parent"), F.lit(1).cast("long").alias("rank"))
    visited = frontier.select("run", F.col("source").alias("target"))
    every, excluded = None, None
    for hop in range(1, depth + 1):
        steps = frontier.join(edges, "source").join(start, "run")
        neutral = steps.where("sign = 0").select("run", "source", "id", "branch", F.lit(hop).alias("hop"))
        live = steps.where("sign != 0 AND target != seed").withColumn("new", F.col("parent") * F.col("sign") * F.col("score"))
        live = materialize(live.select("run", "source", "target", "id", "branch", "rank", "new"), "hop")
        found = live.select("run", "target", "id", "source", "branch", F.col("new").alias("score"), F.lit(hop).alias("hop"))
        every = found if every is None else every.unionAll(found)
        excluded = neutral if excluded is None else excluded.unionAll(neutral)
        if hop == depth:
            break
        first = live.join(visited, ["run", "target"], "left_anti").groupBy("run", "target").agg(F.min(F.struct("rank", "branch", "id", F.col("new").alias("score"))).alias("x"))
        ranked = placed(first.select("run", F.col("target").alias("source"), F.col("x.score").alias("parent"), "x.rank", "x.branch", "x.id"), ["run"], ["rank", "branch", "id", "source"], "next")
        frontier = ranked.select("run", "source", "parent", (F.col("next") + 1).alias("rank"))
        visited = visited.unionAll(frontier.select("run", F.col("source").alias("target")))
    return every, excluded


def combine(found: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(run, target, score, hop, arrivals): independent arrivals of each sign combined, positive less negative."""
    part = lambda keep: 1 - F.coalesce(F.product(F.when(keep, 1 - F.pow(F.least(F.abs("score"), F.lit(1.0)), F.lit(alpha)))), F.lit(1.0))
    sums = found.groupBy("run", "target").agg((part(F.col("score") > 0) - part(F.col("score") < 0)).alias("raw"), F.min("hop").alias("hop"), F.count("*").alias("arrivals"))
    return sums.select("run", "target", (exact_round(F.col("raw"), 6) + F.lit(0.0)).alias("score"), "hop", "arrivals")


def propagate(edges: DataFrame, seeds: list[str], modes: tuple[str, ...] = ("suppress", "promote"), depth: int = 3) -> DataFrame:
    """Affected entities of every seed and mode: (seed, mode, target, score, hop, arrivals). Depth 0 has none."""
    spark = edges.sparkSession
    sign = {"suppress": -1.0, "promote": 1.0}
    rows = [(f"{s}:{m}", s, sign[m]) for s in seeds for m in modes]
    runs = spark.createDataFrame(rows, "run string, entity string, score double")
    if depth == 0 or not rows:
        return spark.createDataFrame([], "seed string, mode string, target string, score double, hop int, arrivals long")
    found, _ = arrivals(materialize(edges, "arcs"), runs, depth)
    out = combine(found)
    return out.select(F.split_part("run", F.lit(":"), F.lit(1)).alias("seed"), F.split_part("run", F.lit(":"), F.lit(2)).alias("mode"), "target", "score", "hop", "arrivals")


def excluded_arcs(edges: DataFrame, seed: str, depth: int = 3) -> DataFrame:
    runs = edges.sparkSession.createDataFrame([("x", seed, -1.0)], "run string, entity string, score double")
    return arrivals(materialize(edges, "arcs"), runs, depth)[1].select("source", "id", "branch", "hop")


def truncate(contributions: DataFrame, depth: int) -> DataFrame:
    """Scores anew from the contributions of at most ``depth`` hops."""
    return combine(contributions.where(F.col("hop") <= depth))


def to_warm(top: DataFrame, cache: DataFrame, depth: int, now, modes: tuple[str, ...] = ("suppress", "promote")) -> DataFrame:
    """(seed, mode) of the entities ``top`` (id) whose result isn't cached, is expired, or isn't as deep as ``depth``; what a warm-up computes in one batch."""
    asked = top.select(F.col("id").alias("seed"), F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return asked.join(cache.where((F.col("expires") > now) & (F.col("max_depth") >= depth)), ["seed", "mode"], "left_anti")


def cached_or_computed(asked: DataFrame, cache: DataFrame, contributions: DataFrame, edges: DataFrame, now) -> DataFrame:
    """(seed, mode, target, score, hop, arrivals, hit) of the requests ``asked`` (seed, mode, depth).

    ``cache`` (seed, mode, max_depth, expires) answers what isn't expired and is as deep at least, by its stored
    ``contributions`` (seed, mode, target, score, hop) cut to the depth; the rest is computed, all of a depth in one loop."""
    fits = (F.col("expires") > now) & (F.col("depth") <= F.col("max_depth"))
    judged = materialize(asked.join(cache, ["seed", "mode"], "left").select("seed", "mode", "depth", F.coalesce(fits, F.lit(False)).alias("hit")), "asked")
    known = contributions.join(judged.where("hit"), ["seed", "mode"]).where("hop <= depth").withColumn("run", F.concat_ws(":", "seed", "mode"))
    out = combine(known).withColumn("hit", F.lit(True))
    fixed = materialize(edges, "arcs")
    for depth in sorted(r["depth"] for r in judged.where("NOT hit AND depth > 0").select("depth").distinct().collect()):  # a few depths
        sign = F.when(F.col("mode") == "suppress", -1.0).otherwise(1.0)
        runs = judged.where((~F.col("hit")) & (F.col("depth") == depth)).select(F.concat_ws(":", "seed", "mode").alias("run"), F.col("seed").alias("entity"), sign.alias("score"))
        out = out.unionByName(combine(arrivals(fixed, runs, depth)[0]).withColumn("hit", F.lit(False)))
    return out.select(F.split_part("run", F.lit(":"), F.lit(1)).alias("seed"), F.split_part("run", F.lit(":"), F.lit(2)).alias("mode"), "target", "score", "hop", "arrivals", "hit")


def neighbourhood(interactions: DataFrame, entities: DataFrame, seeds: list[str], hops: int, limit: int, least: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """(id, entity_a, entity_b, score, hop): edges around the seeds, hop by hop, the strongest first, ``limit`` at most.

    Directions don't count. Edges that earlier hops had still use up a hop's limit, as do those
    that the type filter (either end) takes out. The frontier has at most 2 * limit nodes."""
    spark = interactions.sparkSession
    edges = interactions.where(F.coalesce("score", F.lit(0.0)) >= least).select("id", "entity_a", "entity_b", "score")
    frontier = spark.createDataFrame([(s,) for s in seeds], "node string")
    seen, kept = frontier, None
    for hop in range(1, hops + 1):
        have = 0 if kept is None else kept.count()  # at most limit
        if have >= limit:
            break
        ends = edges.select("*", F.explode(F.array("entity_a", "entity_b")).alias("node"))
        near = ends.join(F.broadcast(frontier), "node", "left_semi").drop("node").distinct().orderBy(F.desc("score"), "id").limit(limit - have)
        if types:
            chosen = entities.where(F.col("entity_type").isin(types)).select("id")
            either = near.select("id", F.explode(F.array("entity_a", "entity_b")).alias("end")).join(chosen.withColumnRenamed("id", "end"), "end", "left_semi").select("id").distinct()
            near = near.join(either, "id", "left_semi")
        near = near if kept is None else near.join(kept.select("id"), "id", "left_anti")
        near = materialize(near.withColumn("hop", F.lit(hop)), "near")
        kept = near if kept is None else kept.unionAll(near)
        nodes = near.select(F.explode(F.array("entity_a", "entity_b")).alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialize(nodes, "frontier")
        seen = seen.unionAll(frontier)
        if frontier.isEmpty():
            break
    return kept


def prospects(edges: DataFrame, source: str, target: str, hops: int) -> DataFrame:
    """(node, left, best): the highest product of scores by which ``left`` arcs at most can lead on from a node to the target.

    Backward from the target, a join and a maximum a hop; nodes that can't reach it in time have no row. Walks may
    repeat nodes, so it bounds the paths from above."""
    inner = edges.where((F.col("source") != target) & (F.col("target") != source)).groupBy("source", "target").agg(F.max("score").alias("score"))
    inner = materialize(inner, "reach")
    here = materialize(inner.where(F.col("target") == target).select(F.col("source").alias("node"), "score"), "prospects")
    out = here.select("node", F.lit(1).alias("left"), F.col("score").alias("best"))
    for left in range(2, hops + 1):
        further = inner.join(here.toDF("target", "onward"), "target").select(F.col("source").alias("node"), (F.col("score") * F.col("onward")).alias("score"))
        here = materialize(here.unionByName(further).groupBy("node").agg(F.max("score").alias("score")), "prospects")
        out = out.unionByName(here.select("node", F.lit(left).alias("left"), F.col("score").alias("best")))
    return out


def _found(edges: DataFrame, onward: DataFrame, source: str, target: str, hops: int, limit: int, beam: int) -> tuple[DataFrame, float | None]:
    """The best ``limit`` paths among those whose beginnings are the ``beam`` most hopeful of their hop, and the bound of the best one that was let go."""
    spark = edges.sparkSession
    live = spark.createDataFrame([(source, [source], [], 1.0, 1)], "tip string, nodes array<string>, ids array<string>, score double, sign int")
    order, done, lost = [F.desc(F.round("score", 6)), F.size("ids"), F.array_join("ids", ">")], None, None
    for hop in range(1, hops + 1):
        tip = F.broadcast(live.select(F.col("tip").alias("source"), "nodes", "ids", F.col("score").alias("s"), F.col("sign").alias("g")))  # ``beam`` rows at most
        step = edges.join(tip, "source").where(~F.array_contains("nodes", F.col("target")))
        step = step.select(F.col("target").alias("tip"), F.concat("nodes", F.array("target")).alias("nodes"), F.concat("ids", F.array("id")).alias("ids"), (F.col("s") * F.col("score")).alias("score"), (F.col("g") * F.col("sign")).alias("sign"))
        here = materialize(step.where(F.col("tip") == target).orderBy(*order).limit(limit), "arrived")
        done = here if done is None else done.unionByName(here)
        if hop == hops:
            break
        ahead = onward.where(F.col("left") == hops - hop).select(F.col("node").alias("tip"), "best")
        hopeful = step.where(F.col("tip") != target).join(ahead, "tip").withColumn("bound", F.col("score") * F.col("best"))
        hopeful = materialize(hopeful.orderBy(F.desc("bound"), F.array_join("ids", ">")).limit(beam + 1), "hopeful")
        if hopeful.count() > beam:
            least = hopeful.agg(F.min("bound")).first()[0]  # that of the first one beyond the beam
            lost = least if lost is None else max(lost, least)
        live = hopeful.orderBy(F.desc("bound"), F.array_join("ids", ">")).limit(beam)
    return done.orderBy(*order).limit(limit), lost


def paths(edges: DataFrame, source: str, target: str, hops: int, limit: int = 50, least: float = 0.0, beam: int = 1_000) -> DataFrame:
    """The ``limit`` simple directed paths of at most ``hops`` arcs with the highest product of scores.

    Parallel arcs are paths of their own; the target is never passed through. The net sign is 0 if an arc's is.
    Best-first: a beginning is worth its own score times the best that can follow (see prospects; scores are at most 1), and in
    each hop the ``beam`` worthiest go on. If none that was let go can be worth as much as the last of the paths found (as
    rounded), these are the best of all; else the beam is widened. So a hop writes no more rows than the beam."""
    near = materialize(edges.where(F.col("score") >= least).select("source", "target", "id", "score", "sign"), "arcs")
    onward = prospects(near, source, target, hops)
    while True:
        found, lost = _found(near, onward, source, target, hops, limit, beam)
        found = materialize(found, "found")
        worst = found.agg(F.count("*"), F.min(F.round("score", 6))).first()
        if lost is None or worst[0] == limit and round(lost, 6) + 1e-6 < worst[1]:
            break
        beam *= 8
    out = found.select(F.array_join("nodes", ">").alias("path"), F.array_join("ids", ">").alias("edges"), F.round("score", 6).alias("score"), F.size("ids").alias("n_hops"), F.col("sign").alias("net_sign"))
    return out.orderBy(F.desc("score"), "n_hops", "edges").limit(limit)
