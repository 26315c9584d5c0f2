"""Operators on small made-up tables: golden values, ties, nulls and empty tables."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from claimweave.functions import output, text, vocab
from claimweave.operators import confidence, conflicts, graph, lookups, planner, resolve
from claimweave.sources import sinks, tabular
from claimweave.streaming import ingest

EDGE = "id string, entity_a string, entity_b string, interaction_type string, effect string, direction string, evidence_count long, score double, label string"


def edges(spark, rows):
    full = [(i, a, b, "signaling", e, d, 1, s, "high") for i, a, b, e, d, s in rows]
    return spark.createDataFrame(full, EDGE)


def nodes(spark, names):
    return spark.createDataFrame([(n, n, "protein", None, 1) for n in names], "id string, canonical_name string, entity_type string, organism string, paper_count long")


def run(spark, rows, seed="S", mode="suppress", depth=3):
    names = {x for r in rows for x in r[1:3]}
    found = graph.propagate(graph.arcs(edges(spark, rows), nodes(spark, names)), [seed], (mode,), depth)
    return {r.target: r for r in found.collect()}


def test_signs_of_propagation(spark):
    one = [("e", "S", "B", "activates", "A_to_B", 0.8)]
    assert run(spark, one)["B"].score < 0
    assert run(spark, one, mode="promote")["B"].score > 0
    assert run(spark, [("e", "S", "B", "inhibits", "A_to_B", 0.8)])["B"].score > 0
    assert run(spark, [("e", "S", "B", "binds", "A_to_B", 0.8)]) == {}


def test_cycles_end_and_depth_holds(spark):
    loop = [("1", "S", "B", "activates", "A_to_B", 0.8), ("2", "B", "C", "activates", "A_to_B", 0.8), ("3", "C", "S", "activates", "A_to_B", 0.8)]
    found = run(spark, loop, depth=4)
    assert {k: v.hop for k, v in found.items()} == {"B": 1, "C": 2}
    assert "C" not in run(spark, loop, depth=1)
    assert run(spark, loop, depth=0) == {}


def queue(arcs, seed, sign, depth):
    """The same walk with a queue: arrivals by target, and excluded arcs."""
    score, hops, order, out, left = {seed: sign}, {seed: 0}, deque([seed]), {}, 0
    while order:
        node = order.popleft()
        if hops[node] == depth:
            continue
        for _, i, target, s, c in sorted((a[2], a[3], a[1], a[4], a[5]) for a in arcs if a[0] == node):
            if s == 0:
                left += 1
                continue
            if target == seed:
                continue
            new = score[node] * s * c
            out.setdefault(target, []).append((new, hops[node] + 1))
            if target not in score:
                score[target], hops[target] = new, hops[node] + 1
                order.append(target)
    return out, left


def joined(values):
    rest = lambda xs: 1 - __import__("math").prod(1 - min(abs(x), 1) ** 0.55 for x in xs)
    return rest([v for v, _ in values if v > 0]) - rest([v for v, _ in values if v < 0])


def test_propagation_equals_a_queue(spark):
    rng = random.Random(3)
    names = "ABCDEFGHIJ"
    rows = [(f"e{i:02d}", rng.choice(names), rng.choice(names), rng.choice(["activates", "inhibits", "binds", None]), rng.choice(["A_to_B", "b_to_a", "bidirectional", "undirected"]), rng.choice([0.0, None, 0.3, 0.9])) for i in range(60)]
    arcs = graph.arcs(edges(spark, rows), nodes(spark, names))
    plain = [(r.source, r.target, r.branch, r.id, r.sign, r.score) for r in arcs.collect()]
    found = graph.propagate(arcs, ["A", "B"], ("suppress", "promote"), 3).collect()
    assert found
    for seed in "AB":
        for mode, sign in (("suppress", -1.0), ("promote", 1.0)):
            want, _ = queue(plain, seed, sign, 3)
            got = {r.target: r for r in found if (r.seed, r.mode) == (seed, mode)}
            assert got.keys() == want.keys()
            for k, v in want.items():
                assert got[k].score == pytest.approx(joined(v), abs=2e-6)
                assert (got[k].hop, got[k].arrivals) == (min(h for _, h in v), len(v))
    assert graph.excluded_arcs(arcs, "A", 3).count() == queue(plain, "A", -1.0, 3)[1]


def test_propagation_over_all_arcs_equals_a_queue(spark):
    from claimweave.plans import catalog

    folder, queries = "/root/testdata/sf0.001", catalog.queries()
    plain = [(r.source, r.target, r.branch, r.id, r.sign, r.score) for r in queries["arcs"](spark, folder).collect()]
    for mode, sign in (("suppress", -1.0), ("promote", 1.0)):
        want, _ = queue(plain, "s0", sign, 3)
        got = {r.target: r for r in queries[f"propagate_{mode}_all"](spark, folder).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k].score == pytest.approx(joined(v), abs=2e-6)
            assert (got[k].hop, got[k].arrivals) == (min(h for _, h in v), len(v))
    batch = queries["propagate_batch_all"](spark, folder).collect()
    for seed in ("s0", "s1", "s2", "s3"):
        want, _ = queue(plain, seed, 1.0, 2)
        assert {r.target: r.arrivals for r in batch if (r.seed, r.mode) == (seed, "promote")} == {k: len(v) for k, v in want.items()}
    left = queries["propagate_excluded_all"](spark, folder).count()
    assert left == queue(plain, "s0", -1.0, 2)[1] == queries["propagate_excluded"](spark, folder).count()


def test_paths_equal_a_search(spark):
    rng = random.Random(5)
    names = "ABCDEFGH"
    rows = [(f"e{i:02d}", *rng.sample(names, 2), "activates", "A_to_B", round(rng.uniform(0.2, 1), 2)) for i in range(40)]
    want = set()

    def walk(node, seen, ids):
        for i, a, b, _, _, s in rows:
            if a == node and s >= 0.3 and b not in seen:
                if b == "H":
                    want.add(">".join([*ids, i]))
                elif len(ids) < 3:
                    walk(b, {*seen, b}, [*ids, i])

    walk("A", {"A"}, [])
    got = graph.paths(graph.arcs(edges(spark, rows), nodes(spark, names)), "A", "H", 4, 10_000, 0.3).collect()
    assert {r.edges for r in got} == want and want
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    order = [(r.score, r.edges) for r in got]
    arcs = graph.arcs(edges(spark, rows), nodes(spark, names))
    for limit, beam in ((5, 2), (12, 3), (40, 1_000)):  # a narrow beam is widened until the best are certain
        assert [(r.score, r.edges) for r in graph.paths(arcs, "A", "H", 4, limit, 0.3, beam).collect()] == order[:limit]


def test_paths_over_all_arcs_equal_a_search(spark):
    """Parallel arcs, ties and all scores: the 50 best of every path of 3 arcs."""
    from claimweave.plans import catalog

    arcs = catalog.queries()["arcs"](spark, "/root/testdata/sf0.001")
    leaving = {}
    for r in arcs.where("score > 0").collect():
        leaving.setdefault(r.source, []).append(r)
    every = []

    def walk(node, seen, ids, score):
        for r in leaving.get(node, []):
            if r.target == "s1":
                every.append((-round(score * r.score, 6), len(ids) + 1, ">".join([*ids, r.id])))
            elif r.target not in seen and len(ids) < 2:
                walk(r.target, {*seen, r.target}, [*ids, r.id], score * r.score)

    walk("s0", {"s0"}, [], 1.0)
    got = graph.paths(arcs, "s0", "s1", 3, 50, beam=64).collect()
    assert [(-r.score, r.n_hops, r.edges) for r in got] == sorted(every)[:50] and len(every) > 50


def test_a_frontier_over_many_partitions(spark):
    """The queue's order over a wide graph of equal scores, and no window over a run's rows in the plan."""
    rng = random.Random(8)
    names = [f"n{i}" for i in range(120)]
    rows = [(f"e{i:04d}", rng.choice(names), rng.choice(names), rng.choice(["activates", "inhibits"]), rng.choice(["A_to_B", "bidirectional"]), rng.choice([0.5, 0.9])) for i in range(600)]
    arcs = graph.arcs(edges(spark, rows), nodes(spark, names))
    plain = [(r.source, r.target, r.branch, r.id, r.sign, r.score) for r in arcs.collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.target: r for r in graph.propagate(arcs, ["n0"], ("suppress",), 4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want, _ = queue(plain, "n0", -1.0, 4)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k].score == pytest.approx(joined(v), abs=2e-6) and got[k].arrivals == len(v)


def test_neighbourhood_limits(spark):
    rows = [(f"e{i}", "A", f"N{i}", "activates", "A_to_B", 0.5 + i / 100) for i in range(9)] + [("z", "N8", "Q", "activates", "A_to_B", 0.99)]
    got = graph.neighbourhood(edges(spark, rows), nodes(spark, ["A"]), ["A"], 2, 3).collect()
    assert {r.id for r in got} == {"e8", "e7", "e6"}
    assert {r.id for r in graph.neighbourhood(edges(spark, rows), nodes(spark, ["A"]), ["A"], 2, 50).collect()} == {r[0] for r in rows}


def test_vocabulary(spark):
    row = spark.range(1).select(
        vocab.normalise(F.lit("Homo sapiens"), vocab.ORGANISM_RULES, "organism").alias("a"),
        vocab.normalise(F.lit("HEK293"), vocab.TISSUE_RULES, "context").alias("b"),
        vocab.normalise(F.lit("hypoxic stress"), vocab.CONDITION_RULES, "condition").alias("c"),
        vocab.normalise(F.lit("co-immunoprecipitation"), vocab.ASSAY_RULES, "assay").alias("d"),
        vocab.normalise(F.lit(" New-Thing! "), vocab.ASSAY_RULES, "assay").alias("e"),
        vocab.normalise(F.lit("??"), vocab.ASSAY_RULES, "assay").alias("f"),
        vocab.enum(F.lit("Small Molecule"), vocab.ENTITY_ALIASES).alias("g"),
        vocab.enum(F.lit(None).cast("string"), vocab.ENTITY_ALIASES).alias("h"),
        vocab.clamp(F.lit("x")).alias("i"),
        vocab.clamp(F.lit("7")).alias("j"),
        vocab.sign(F.lit(" Inhibits\n")).alias("k"),
        vocab.non_mammalian(F.lit("Danio rerio (AB)")).alias("l"),
    ).first()
    assert tuple(row) == ("human", "cell_line:hek293", "hypoxia", "protein_interaction:coip", "assay:new_thing", None, "molecule", "unknown", 0.3, 1.0, -1, True)


def test_conflict_outcomes_and_classes(spark):
    ev = "interaction_id string, id string, paper_id string, evidence_type string, adjudication_score double, verification_score double, norm_organism string, norm_tissue string, norm_condition string, organism string, tissue_cell_type string, condition string"
    rows = [("x", "1", "p1", "in_vitro", 0.7, 0.5, "human", None, None, "human", None, None), ("y", "2", "p2", "in_vitro", 0.68, 0.5, "mouse", None, None, "mouse", None, None)]
    evidence = spark.createDataFrame(rows, ev)
    two = edges(spark, [("x", "A", "B", "activates", "A_to_B", 0.5), ("y", "A", "B", "inhibits", "A_to_B", 0.5)])
    found = conflicts.detect(two, evidence)
    assert [(r.conflict_type, r.conflict_axis) for r in found.collect()] == [("context_dependent", "effect")]
    out = conflicts.outcomes(found, evidence).first()
    assert (out.status, out.recommended) == ("resolved", "context_dependent")
    assert conflicts.detect(two, evidence, found).isEmpty()
    undirected = edges(spark, [("x", "A", "B", "binds", "A_to_B", 0.5), ("y", "A", "B", "binds", None, 0.5)])
    assert conflicts.candidates(undirected, evidence).isEmpty()
    back = edges(spark, [("x", "A", "B", "activates", "A_to_B", 0.5), ("y", "B", "A", "inhibits", "A_to_B", 0.5)])
    assert [r.reversed for r in conflicts.candidates(back, evidence).collect()] == [True]


def test_low_degree(spark):
    rows = edges(spark, [("1", "A", "B", "binds", "undirected", 1.0), ("2", "C", "B", "binds", "undirected", 1.0)])
    assert [r.id for r in lookups.low_interaction(nodes(spark, "ABC"), rows, 2, 9).collect()] == ["A", "C"]
    with pytest.raises(ValueError):
        lookups.search(nodes(spark, "A"), spark.createDataFrame([("A", "a")], "entity_id string, synonym string"), "  ")


def test_slots():
    assert planner.allocate({"conflict": 1.0, "entity": 1.0, "interaction": 1.0}, 3) == {"conflict": 1, "entity": 1, "interaction": 1}
    assert sum(planner.allocate({"conflict": 9.0, "entity": 0.1, "interaction": 1.0}, 8).values()) == 8
    assert planner.allocate({"conflict": 1.0, "entity": 1.0, "interaction": 1.0}, 1) == {"conflict": 1, "entity": 1, "interaction": 1}


def test_attribution(spark):
    papers = spark.createDataFrame([("p", ["q1", "q2"])], "id string, query_ids array<string>")
    outcomes = spark.createDataFrame([("p", 2, 4)], "paper_id string, n_interactions long, n_evidence long")
    assert {(r.attributed_interactions, r.attributed_evidence) for r in planner.attribute(papers, outcomes).collect()} == {(1.0, 2.0)}


def test_chunks_cover_texts():
    body = ("word " * 50 + ". " + "x" * 30 + "\n\n") * 20
    parts = text.cut(body, 600, 100)
    assert parts[0][0] == 0 and parts[-1][1] == len(body)
    assert all(a2 <= b1 and a2 > a1 for (a1, b1), (a2, _) in zip(parts, parts[1:]))
    assert text.cut("short", 600, 100) == [(0, 5)] and text.cut("", 10, 2) == [(0, 0)]


def test_repair():
    assert text.repair('<think>{"a": 1}</think> x {"b": [1, 2') == '{"b": [1, 2]}'
    assert text.repair('{"b": {"c": "d", "e": ') == '{"b": {"c": "d"}}'
    assert text.repair("nothing") is None


def test_snippets(spark):
    rows = spark.createDataFrame([("tiny", "abc"), ("the quick brown fox", "So THE QUICK brown fox ran"), ("the quick brown fox jumps over", "the quick brawn fox jumped over"), ("utterly different words here", "1234567890" * 9), (None, "x")], "snippet string, text string")
    assert {r.snippet: r.found for r in text.snippets_supported(rows).collect()} == {"tiny": True, "the quick brown fox": True, "the quick brown fox jumps over": True, "utterly different words here": False, None: False}


def test_cascade(spark):
    entities = spark.createDataFrame([("1", "Alpha kinase", "protein", None, 1), ("2", "beta", "gene", "human", 1), ("3", "beta", "metabolite", None, 1)], "id string, canonical_name string, entity_type string, organism string, paper_count long")
    synonyms = spark.createDataFrame([("1", "alpha kinase"), ("2", "beta"), ("3", "beta")], "entity_id string, synonym string")
    asked = spark.createDataFrame([("a", "ALPHA KINASE", "gene", None), ("b", "Beta", "protein", None), ("c", "Alpha kinasse", "gene", None), ("d", "gamma", "gene", None), ("e", "Gamma ", "protein", None)], "mention string, name string, entity_type string, organism string")
    got = {r.mention: (r.entity_id, r.how) for r in resolve.cascade(asked, entities, synonyms).collect()}
    assert got == {"a": ("1", "exact:unique"), "b": ("2", "exact:group"), "c": ("1", "fuzzy"), "d": ("new:gene_protein:gamma", "created"), "e": ("new:gene_protein:gamma", "created")}


def test_fuzzy_equals_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(4)
    names = ["".join(rng.choice("abcd12") for _ in range(rng.randrange(8, 30))) for _ in range(60)]
    keys = []
    for n in names:
        k = list(n)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(k))
            k[i : i + 1] = rng.choice(["", "x", "a"])
        keys.append("".join(k))
    entities = spark.createDataFrame([(f"{i:02d}", n, "protein") for i, n in enumerate(names)], "id string, canonical_name string, entity_type string")
    asked = spark.createDataFrame([(str(i), k, "gene") for i, k in enumerate(keys)], "mention string, name string, entity_type string")
    got = {r.mention: (r.entity_id, r.ratio) for r in resolve.fuzzy(asked, entities).collect()}
    want = {}
    for i, k in enumerate(keys):
        best = min((-SequenceMatcher(None, k, n).ratio(), f"{j:02d}") for j, n in enumerate(names))
        if -best[0] >= 0.92:
            want[str(i)] = (best[1], round(-best[0], 6))
    assert got == want and len(want) > 10


def test_fuzzy_of_long_names_equals_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(11)
    names = ["complex of " * (i % 3) + "".join(rng.choice("abcdef12 ") for _ in range(rng.randrange(12, 90))).strip() for i in range(90)]
    keys = []
    for n in names * 2:
        k = list(n)
        for _ in range(rng.randrange(1 + len(k) // 8)):
            i = rng.randrange(len(k))
            k[i : i + 1] = rng.choice(["", "x", "a", k[i] + "b"])
        keys.append("".join(k).strip())
    names += [f"protein of the common family number {i:04d} of many" for i in range(40)] + ["a" * 40, "ab" * 20, ""]
    keys += ["protein of the common family number 0017 of man", "a" * 37, "ab" * 18 + "b", "", "a"]
    rows = spark.createDataFrame([(k, "p") for k in dict.fromkeys(keys)], "key string, g string")
    known = spark.createDataFrame([(n, "p", str(i)) for i, n in enumerate(dict.fromkeys(names))], "name string, g string, entity_id string")
    for least in (0.92, 0.85, 0.74):
        found = {(r.key, r.name) for r in resolve.candidates(rows, known, least).collect()}
        want = {(k, n) for k in keys for n in names if k and n and SequenceMatcher(None, k, n).ratio() >= least}
        assert want <= found and len(want) > 60, least
    assert resolve.gram_width(0.92) == 4 and resolve.gram_width(0.4) == 1
    sized = known.where("length(name) > 12").withColumn("lb", F.length("name"))
    most = F.array_max(F.transform(resolve._reach(F.length("name"), 0.92), lambda m: resolve._spoilt(F.length("name"), m, 4, 0.92)))
    index = resolve._rarest(resolve._grams(sized.withColumn("most", most), "name", 4), spark.createDataFrame([], "g string, lb int, block long, often long"), "name", ["entity_id"])
    assert all(r["count"] <= 0.7 * len(r["name"]) for r in index.groupBy("name").count().collect())  # linear in the length


def test_cache(spark):
    kind = "entity string, mode string, max_depth int, result string, expires int, hits int"
    old, new = spark.createDataFrame([("a", "s", 3, "deep", 1, 5)], kind), spark.createDataFrame([("a", "s", 2, "shallow", 9, 0), ("b", "s", 1, "b", 9, 0)], kind)
    merged = resolve.merge_cache(old, new)
    assert sorted(map(tuple, merged.collect())) == [("a", "s", 3, "deep", 9, 0), ("b", "s", 1, "b", 9, 0)]
    asked = spark.createDataFrame([("a", "s", 2), ("b", "s", 2)], "entity string, mode string, depth int")
    assert [r.entity for r in resolve.cache_hits(merged, asked, F.lit(5)).collect()] == ["a"]


def test_escaped_export(spark):
    lines = sinks.graphml(spark.createDataFrame([("1", 'a<b>&"c"', None)], "id string, canonical_name string, entity_type string"), edges(spark, []))
    assert "a&lt;b&gt;&amp;&quot;c&quot;" in lines.first().line


def test_mitab_skips(spark):
    good = "\t".join(["uniprotkb:P04637-2", "uniprotkb:Q00987", *["-"] * 6, "pubmed:1|doi:x|pubmed:2", "-", "-", 'psi-mi:"MI:0915"(physical association)', "-", "a|reactome:R-1"])
    lines = spark.createDataFrame([(good,), ("#" + good,), ("a\tb",), (good.replace("Q00987", "P04637"),)], "line string")
    assert [tuple(r) for r in tabular.psi_mitab(lines).collect()] == [("P04637", "Q00987", "MI:0915", "R-1", "1,2", "proximal_association", "binds", "undirected")]


def test_stream_ingests_once(spark, tmp_path):
    kind = "interaction_id string, paper_id string, line_no int, confidence_score double, entity_a string, entity_b string, interaction_type string, effect string, direction string, evidence_type string"
    row = lambda p, n: ("i", p, n, 0.8, "A", "B", "signaling", "activates", "A_to_B", "in_vitro")
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([row("p1", 1), row("p1", 2)], kind).coalesce(1).write.parquet(source)
    ingest.ingest(spark, source, kind, folder).awaitTermination()
    spark.createDataFrame([row("p1", 3), row("p2", 1)], kind).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, kind, folder).awaitTermination()
    assert spark.read.parquet(f"{folder}/evidence").count() == 2
    metrics = sorted((r.cycle, r.evidence) for r in spark.read.parquet(f"{folder}/metrics").collect())
    assert metrics[-1][1] == 2 and metrics[0] == (0, 1)


def test_empty_tables(spark):
    none = edges(spark, [])
    assert lookups.degree(none).count() == 0
    assert graph.propagate(graph.arcs(none, nodes(spark, ["A"])), ["A"], ("suppress",), 2).count() == 0
    assert confidence.strongest(none, 5).count() == 0


def test_output_is_gone_over_once(spark):
    """Parsing isn't done again for snippets that need a comparison; whole objects aren't scanned for brackets."""
    said = '{"interactions": [{"entity_a": "a", "entity_b": "b", "snippet": "%s", "organism": " Danio Rerio "}, {"entity_a": "a", "entity_b": "b", "snippet": "%s"}]}'
    snippets = ("a stimulates b in liver cells", "there is nothing like this here")
    rows = spark.createDataFrame([("p", said % (snippets[0], snippets[1]), "It is shown that a stimulates b, in liver cells"), ("q", said % (snippets[1], snippets[0]), "It is shown that a stimulates b, in liver cells"), ("r", None, "x")], "paper_id string, said string, text string")
    found = output.interactions(output.parse_calls(rows, "said"))
    assert {(r.paper_id, r.confidence_score) for r in found.collect()} == {("p", 0.3), ("q", 0.3)}
    levels = text.snippets_supported(rows.select("paper_id", F.lit(snippets[0]).alias("snippet"), "text"))
    assert {(r.paper_id, r.found) for r in levels.collect()} == {("p", True), ("q", True), ("r", False)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "MapInPandas" not in plan and plan.count("ArrowEvalPython") == 2


def test_whole_objects_are_read_as_repaired_ones_are(monkeypatch):
    tried = []
    monkeypatch.setattr(text, "closed", lambda body: tried.append(body))
    assert text.repair('see {"b": ["}", {"a": "\\\\"}], "a": NaN} and {') == '{"a": NaN, "b": ["}", {"a": "\\\\"}]}' and not tried
    assert output.arguments('<tool_call>{"name": "x", "arguments": "{\\"b\\": 1, \\"a\\": 2}"}</tool_call>') == '{"a": 2, "b": 1}' and not tried
    text.repair('{"a": [1')
    assert tried == ['{"a": [1']
