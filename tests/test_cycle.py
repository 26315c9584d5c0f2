"""The composed cycle: replays after breaks, scores and conflicts as of a whole computation, untouched buckets."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimweave.config import Config
from claimweave.operators import confidence, conflicts, resolve
from claimweave.sources.buckets import Tables
from claimweave.streaming import cycle

NAMES = ["TP53", "MDM2", "EGFR", "KRAS", "Aspirin", "p21 protein", "AKT1", "Beta catenin"]


def claims(spark, seed, n=40, papers=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample(NAMES, 2)
        # a name that only this batch has, and another way of writing a known one
        a = rng.choice([a, f" {a.lower()} ", f"new{seed}"])
        rows.append((a, b, rng.choice(["protein", "gene", None]), "protein", rng.choice(["direct_binding", "signaling"]), rng.choice(["activates", "inhibits", None]), rng.choice(["A_to_B", "B_to_A", "undirected"]), f"{seed % 2}-paper{rng.randrange(papers)}", i, rng.choice(["in_vivo", "curated_db", "computational"]), rng.choice([0.2, 0.5, 0.9]), rng.choice([None, 0.0, 0.7]), f"text {i}", rng.choice([2001, 2023, None]), rng.choice(["human", "mouse", None]), None, rng.choice([None, "hypoxia"])))
    return spark.createDataFrame(rows, cycle.CLAIMS)


def verdicts(asked):
    return asked.select("id", F.when(F.length("id") % 2 == 0, "true_conflict").alias("verdict"), F.lit(0.8).alias("weight"), F.concat(F.lit("since "), "id").alias("reasons"))


def contents(spark, folder):
    t = cycle.tables(spark, folder, 4)
    return {name: sorted(map(str, t.read(name).collect())) for name in cycle.SCHEMAS}


SETTINGS = Config(conflicts_per_cycle=5, targeted_per_cycle=6)


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    """Three batches; a copy of the folder is kept after each of the first two."""
    folder = str(tmp_path_factory.mktemp("unbroken"))
    for n in range(3):
        cycle.run_batch(cycle.tables(spark, folder, 4), claims(spark, n), n, SETTINGS, verdicts)
        if n < 2:
            shutil.copytree(folder, f"{folder}-{n}")
    return folder


def test_equals_a_whole_computation(spark, unbroken):
    t = cycle.tables(spark, unbroken, 4)
    evidence, edges = t.read("evidence"), t.read("interactions")
    keys = [(r.interaction_id, r.paper_id) for r in evidence.collect()]
    assert len(set(keys)) == len(keys) > 60
    whole = {r.id: (r.evidence_count, r.score, r.label) for r in confidence.composite(evidence).collect()}
    assert {r.id: (r.evidence_count, r.score, r.label) for r in edges.collect()} == whole
    detected = {(r.interaction_a, r.interaction_b) for r in conflicts.detect(edges, evidence).collect()}
    stored = {(r.interaction_a, r.interaction_b) for r in t.read("conflicts").collect()}
    assert stored == detected and len(stored) > 5
    every = t.read("entities").collect()
    names = {e.id: e for e in every}
    papers = evidence.select("paper_id", F.explode(F.array("entity_a", "entity_b")).alias("id")).distinct().groupBy("id").count().collect()
    assert all(names[r.id].paper_count >= r["count"] for r in papers)
    kinds = [(e.canonical_name.lower().strip(), "gene" if e.entity_type == "protein" else e.entity_type) for e in every]
    assert len(set(kinds)) == len(kinds)  # later batches see the entities of earlier ones
    metrics = sorted(t.read("metrics").collect())
    assert [m.cycle for m in metrics] == [0, 1, 2] and metrics[-1].interactions == len(whole) and metrics[-1].evidence == len(keys) and metrics[-1].entities == len(every)
    assert sum(m.new_evidence for m in metrics) == len(keys) and sum(m.new_conflicts for m in metrics) == len(stored) and sum(m.new_interactions for m in metrics) == len(whole)
    assert t.read("claims").count() == 120
    states = {r.status for r in t.read("conflicts").collect()}
    assert "investigating" in states and any((r.analysis or "").startswith("since ") for r in t.read("conflicts").collect())
    searches = t.read("searches").collect()
    assert {r.reason for r in searches} >= {"conflict_follow_up", "unresolved_conflict_hub"} and len({r.id for r in searches}) == len(searches)


@pytest.mark.parametrize("broken_at", [2, 5, 8])
def test_a_replay_after_a_break_changes_nothing(spark, unbroken, tmp_path, monkeypatch, broken_at):
    """The second batch ends between two writes, or before the marker; it is run again by a new process."""
    folder = str(tmp_path / "tables")
    shutil.copytree(f"{unbroken}-0", folder)
    before, done, put, commit = contents(spark, folder), [], Tables.put, Tables.commit

    def failing(self, *args):
        if len(done) == broken_at:
            raise RuntimeError("lost")
        done.append(args[1] if len(args) > 1 else "marker")
        return (put if len(args) > 1 else commit)(self, *args)

    with monkeypatch.context() as m:
        m.setattr(Tables, "put", failing)
        m.setattr(Tables, "commit", failing)
        with pytest.raises(RuntimeError):
            cycle.run_batch(cycle.tables(spark, folder, 4), claims(spark, 1), 1, SETTINGS, verdicts)
    assert contents(spark, folder) == before and len(done) == broken_at
    for n in (1, 1, 0):  # again, once more, and an old one
        cycle.run_batch(cycle.tables(spark, folder, 4), claims(spark, n), n, SETTINGS, verdicts)
    assert contents(spark, folder) == contents(spark, f"{unbroken}-1")


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    folder = str(tmp_path)
    t = Tables(spark, folder, {"x": "k string, v int"}, {"x": "k"}, 8)
    first = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    t.put(0, "x", first, list(range(8)))
    t.commit(0)
    files = lambda: {str(p) for p in Path(folder).rglob("x/**/*.parquet")}
    old = files()
    change = spark.createDataFrame([("k3", 33)], "k string, v int")
    at = t.touched(change, "k")
    assert len(at) == 1
    t.put(1, "x", t.read("x", at).where("k != 'k3'").unionByName(change), at)
    assert {r.v for r in t.read("x").collect()} == set(range(50))  # not yet seen
    t.commit(1)
    assert {r.v for r in Tables(spark, folder, t.schemas, t.keys, 8).read("x").collect()} == set(range(50)) - {3} | {33}
    assert old < files() and all(f"bucket={at[0]}" in f for f in files() - old)
    t.put(2, "x", t.read("x", at).limit(0), at)  # a bucket that gets empty
    t.commit(2)
    assert t.vacuum() >= 1 and t.read("x").count() == 50 - first.where(t.bucket(F.col("k")) == at[0]).count()


def test_stream_and_empty_batch(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    claims(spark, 1).coalesce(1).write.parquet(source)
    cycle.stream(spark, source, folder, SETTINGS, buckets=4).awaitTermination()
    claims(spark, 1).limit(0).coalesce(1).write.mode("append").parquet(source)
    cycle.stream(spark, source, folder, SETTINGS, buckets=4).awaitTermination()
    t = cycle.tables(spark, folder, 4)
    assert t.last >= 0 and t.read("evidence").count() > 10


def test_plans_of_a_batch_are_cut(spark, tmp_path, monkeypatch):
    """The driver holds one plan at a time, and none of them has the steps before it."""
    sizes, write = [], Tables.put

    def noted(df, label, plain=cycle.materialize):
        sizes.append((len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()), label))
        return plain(df, label)

    def put(self, n, name, rows, only):
        sizes.append((len(rows._jdf.queryExecution().optimizedPlan().toString().splitlines()), name))
        write(self, n, name, rows, only)

    for module in (cycle, conflicts, resolve):
        monkeypatch.setattr(module, "materialize", noted)
    monkeypatch.setattr(Tables, "put", put)
    for n in range(2):
        cycle.run_batch(cycle.tables(spark, str(tmp_path), 4), claims(spark, n), n, SETTINGS, verdicts)
    assert max(sizes)[0] < 400, max(sizes)
