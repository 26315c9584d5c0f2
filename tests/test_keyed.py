"""Evidence and interactions by keys hold the rows of their statements; queries write and shuffle no more than they need."""

from datetime import datetime
from pathlib import Path

import pytest

from claimweave.operators import confidence, conflicts, lookups
from claimweave.plans import catalog, projection
from claimweave.plans.projection import BASE, PROJECTION, Model
from claimweave.session import materialize

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, unknown papers and customers, papers that are there twice, claims that are repeated or differ in one column only."""
    folder = tmp_path_factory.mktemp("odd")
    day = datetime(2001, 5, 6)
    tables = {
        "nation": ([(0, "N0", 0), (1, "N1", 3), (2, "N2", 4), (3, "N3", None)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "c1", 0, 1.0, "BUILDING"), (2, "c2", 1, 1.0, "MACHINERY"), (3, "c3", 2, 1.0, None), (4, "c4", 9, 1.0, "X"), (5, "c5", 3, 1.0, "X")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(10, 1, "O", 1.0, day, "1-URGENT"), (11, 2, "F", 1.0, day, "5-LOW"), (12, 3, "F", 1.0, None, "3-Medium"), (13, 4, "F", 1.0, day, "2"), (14, 77, "F", 1.0, day, "2"), (15, 5, "F", 1.0, day, None), (15, 1, "F", 1.0, day, "4"), (None, 1, "F", 1.0, day, "4")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "supplier": ([(k, f"Supplier {k}", 0, 100.0) for k in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(k, f"part {k}", "Brand", "T", k, 1.0) for k in range(4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    }
    lines, flags, n = [], ("A", "R", "N", None), 0
    for o in (10, 11, 12, 13, 14, 15, 99, None):
        for s, p in ((1, 1), (1, 2), (2, 1), (None, 1), (1, None)):
            for line in (1, 2, 3, 4, 6, 7, 8, None, -1):
                n += 1
                lines.append((o, p, s, line, float(n % 5), float(n % 3), n % 4 / 10, 0.0 if n % 3 else None if n % 2 else 0.1, flags[n % 4], ("O", "F", None)[n % 3]))
    lines += [(10, 1, 1, 1, q, price, d, tax, flag, "F") for q in (5.0, None, float("nan")) for price in (1.0, None) for d in (0.1, None) for tax in (0.0, 0.2) for flag in ("A", "B", "C")]
    tables["lineitem"] = (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def as_stated(spark, m):
    """Evidence as its statement has it."""
    text = PROJECTION["evidence"]
    return spark.sql(text, **{t: m[t] for t in (*BASE, "papers", "claims") if f"{{{t}}}" in text})


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_evidence_and_interactions_hold_the_rows_of_their_statements(spark, odd):
    m = Model(spark, odd)
    want = as_stated(spark, m)
    assert m["evidence"].columns == want.columns and rows(m["evidence"]) == rows(want) and want.count() > 100
    assert rows(m.interactions) == rows(confidence.composite(want))
    assert rows(m.stored()["evidence"]) == rows(want) and rows(m.stored().interactions) == rows(m.interactions)


def test_all_conflicts_are_between_contested_claims(spark, odd):
    for folder in (odd, FOLDER):
        m = Model(spark, folder)
        whole = conflicts.detect(m.interactions, confidence.with_contexts(m["evidence"]))
        part = conflicts.detect(m.contested.interactions, confidence.with_contexts(m.contested["evidence"]))
        assert rows(part) == rows(whole) and whole.count() > 0
    assert m.contested["evidence"].count() < m["evidence"].count()


WHOLE = {"pieces", "evidence", "adjudicated"}
NO_EDGES = ("conflicts_refreshed", "conflict_view", "verification_phase", "conflict_hubs", "conflict_view_entity", "verification_candidates", "conflicts_resolved", "conflict_outcomes", "conflicts_analysed",)


@pytest.mark.parametrize("name", (*NO_EDGES, "entity_stats", "targeted_queries", "paths", "degree_by_direction", "evidence_drawer"))
def test_queries_write_no_table_that_they_do_not_read(spark, name):
    """All evidence is written by none of them; all interactions only by those that go over them."""
    projection.forget()
    catalog.queries()[name](spark, FOLDER).collect()
    kept = {key[2] for key in projection.STORED if key[1] == FOLDER}
    assert not kept & WHOLE
    assert ("interactions" in kept) == (name not in NO_EDGES)


def test_entity_stats_by_counts_of_interactions(spark):
    edges = spark.createDataFrame([("x", "a", "b", 2), ("y", "a", "a", 3), ("z", "b", "c", 1)], "id string, entity_a string, entity_b string, evidence_count long")
    evidence = spark.createDataFrame([("x",), ("x",), ("y",), ("y",), ("y",), ("z",)], "interaction_id string")
    clash = spark.createDataFrame([("x", "open"), ("x", "reopened"), ("y", "open"), ("z", "resolved")], "interaction_a string, status string")
    want = {("a", 5, 3), ("b", 3, 2), ("c", 1, 0)}
    for got in (lookups.entity_stats(edges, evidence, clash), lookups.entity_stats(edges, None, clash), lookups.entity_stats(edges, None, clash, edges.where("id != 'z'"))):
        assert {tuple(r) for r in got.collect()} == want


def test_written_copies_leave_no_shuffle_files(spark):
    folders = [Path(str(d)) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    before = files()
    kept = materialize(spark.range(20_000).repartition(4, "id").groupBy("id").count(), "kept")
    assert kept.count() == 20_000
    left = files() - before
    for _ in range(50):  # they are deleted beside
        left = {f for f in left if f.exists()}
        if sum(f.stat().st_size for f in left) < 10_000:
            break
        __import__("time").sleep(0.1)
    assert sum(f.stat().st_size for f in left) < 10_000
