"""Loads, writes, settings, schemas, model output and texts on small made-up rows, held against the rules written out."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from claimweave.config import Config
from claimweave.functions import output, text
from claimweave.operators import lookups, resolve, writes
from claimweave.plans import schema
from claimweave.sources import entries, sinks


def test_settings():
    assert Config.load({}, {}).penalty == 1.0
    got = Config.load({"penalty": 2, "second_source": "no"}, {"CLAIMWEAVE_PENALTY": "0.5", "CLAIMWEAVE_CHUNK_CHARS": "10", "OTHER": "x"})
    assert (got.penalty, got.chunk_chars, got.second_source) == (0.5, 10, False)
    with pytest.raises(KeyError):
        Config.load({"unknown": 1}, {})


def test_schemas_are_created_and_migrated_once(spark, tmp_path):
    folder = str(tmp_path)
    assert set(schema.create(spark, folder)) == set(schema.TABLES) and schema.create(spark, folder) == []
    assert schema.migrate(spark, folder) == []
    spark.createDataFrame([("e", "s", 7)], "entity_id string, synonym string, own int").write.mode("overwrite").parquet(f"{folder}/synonyms")
    assert schema.migrate(spark, folder) == ["synonyms"]
    assert spark.read.parquet(f"{folder}/synonyms").collect()[0].asDict() == {"entity_id": "e", "synonym": "s", "source": None, "own": 7}


def test_reset_empties_tables_that_it_reads(spark, tmp_path):
    folder = str(tmp_path)
    tables = {}
    for name in ("entities", "evidence"):
        spark.range(3).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
    sinks.reset(tables, folder)
    assert [spark.read.parquet(f"{folder}/{n}").count() for n in tables] == [3, 0]
    sinks.reset({n: spark.read.parquet(f"{folder}/{n}") for n in tables}, folder, hard=True)
    assert spark.read.parquet(f"{folder}/entities").count() == 0


def test_budgets_equal_a_loop(spark):
    """A pool that searches fill and extraction empties, a share for each search, and a last pass over what is left."""
    rng = random.Random(3)
    rows = [(c, k, rng.choice([0, 2, 5, 30, None])) for c in range(12) for k in range(rng.randrange(1, 7))]
    pools = {c: rng.choice([0, 1, 7, 40]) for c in range(3, 14)}
    table = spark.createDataFrame(rows, "cycle int, place int, found long")
    waiting = spark.createDataFrame(list(pools.items()), "cycle int, waiting long")
    for given in (None, waiting):
        got = {(r.cycle, r.place): r.taken for r in writes.budgets(table, "cycle", "place", "found", 20, given).collect()}
        want = {}
        for c in {r[0] for r in rows} | (set(pools) if given else set()):
            pool, consumed, own = pools.get(c, 0) if given else 0, 0, sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
            for i, (_, k, found) in enumerate(own):
                pool += found or 0
                left = 20 - consumed
                taken = min(max(1, -(-left // (len(own) - i))), left, pool) if left > 0 else 0
                want[c, k], pool, consumed = taken, pool - taken, consumed + taken
            want[c, None] = min(20 - consumed, pool)
        assert got == want
    assert any(k is None and v for (_, k), v in want.items())


def test_updates_keep_what_is_not_given(spark):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, None)], "id int, note string, weight double")
    changes = spark.createDataFrame([(1, "", None), (3, "long note", 0.0), (9, "x", 1.0)], "id int, note string, weight double")
    got = {r.id: (r.note, r.weight) for r in writes.update(table, changes, "id", ("weight",), ("note",), {"note": 4}).collect()}
    assert got == {1: ("a", None), 2: ("b", 2.0), 3: ("long", 0.0)}
    seeds = spark.createDataFrame([("q", "pubmed"), ("q", "pubmed"), ("r", "pubmed")], "query_text string, source_api string")
    past = spark.createDataFrame([("r", "pubmed", "done")], "query_text string, source_api string, status string")
    assert [r.query_text for r in writes.seed_queries(seeds, past).collect()] == ["q"]
    assert {r.query_text for r in writes.seed_queries(seeds, past.withColumn("status", F.lit("failed"))).collect()} == {"q", "r"}
    assert writes.seed_queries(seeds, past.withColumn("status", F.lit("pending"))).count() == 0


def test_calls_in_several_forms():
    want = '{"entities": [{"name": "x"}], "note": "a b"}'
    assert output.arguments('<tool_call>\n<function=save>\n<parameter=entities>[{"name": "x"}]</parameter><parameter=note> a b </parameter></function></tool_call>') == want
    assert output.arguments('<think>{"no": 1}</think><tool_call>{"name": "save", "arguments": {"entities": [{"name": "x"}], "note": "a b"}}</tool_call>') == want
    assert output.arguments('<tool_call>{"arguments": "{\\"entities\\": []}"}</tool_call>') == '{"entities": []}'
    assert output.arguments('<tool_call>{"entities": [{"name": "x"') == '{"entities": [{"name": "x"}]}'
    assert output.arguments('so: {"interactions": [1, 2') == '{"interactions": [1, 2]}'
    assert output.arguments(None) is None and output.arguments("nothing") is None


def test_output_of_odd_shapes(spark):
    rows = spark.createDataFrame([(1, '{"entities": "none", "interactions": [1, "x", {"entity_a": "a"}, {"entity_a": "a", "entity_b": "b", "interaction_type": "", "confidence": "sure", "snippet": "short"}]}', "t"), (2, "[]", "t"), (3, None, None)], "paper_id int, parsed string, text string")
    assert output.entities(rows).count() == 0
    got = output.interactions(rows).collect()
    assert [(r.paper_id, r.interaction_type, r.direction, r.evidence_type, r.confidence, r.confidence_score) for r in got] == [(1, "unknown", "undirected", "unknown", "low", 0.3)]


def test_cut_equals_its_rule():
    rng = random.Random(6)

    def by_rule(body, most, overlap):
        if len(body) <= most:
            return [(0, len(body))]
        out, start = [], 0
        while True:
            stop = len(body)
            if start + most < len(body):
                stop = start + most
                for mark in ("\n\n", ". "):
                    ends = [i + 2 for i in range(start, stop - 1) if body[i : i + 2] == mark and i > start + most // 2]
                    if ends:
                        stop = max(ends)
                        break
            out.append((start, stop))
            if stop == len(body):
                return out
            start = min(stop, max(stop - overlap, start + 1))

    for _ in range(300):
        body = "".join(rng.choice("ab. \n") for _ in range(rng.randrange(120)))
        most, overlap = rng.randrange(2, 40), rng.randrange(30)
        assert text.cut(body, most, overlap) == by_rule(body, most, overlap), (body, most, overlap)


def test_similar_windows_equal_comparing_all():
    rng = random.Random(7)
    found = 0
    for _ in range(150):
        body = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(10, 400)))
        at = rng.randrange(len(body))
        want = list(body[at : at + rng.randrange(10, 90)]) or ["a"]
        for _ in range(rng.randrange(len(want))):
            want[rng.randrange(len(want))] = rng.choice("abcxyz")
        want = "".join(want)
        stride = max(len(want) // 2, 50)
        true = any(SequenceMatcher(None, want, body[i : i + len(want) + 50]).ratio() >= 0.6 for i in range(0, max(1, len(body) - len(want) + 1), stride))
        assert resolve.similar_window(want, body, 0.6) == true
        found += true
    assert 20 < found < 140


def test_cascade_takes_the_first_name_and_outside_answers(spark):
    entities = spark.createDataFrame([("1", "Alpha", "protein", None), ("2", "Beta long name", "metabolite", None), ("3", "TP9", "protein", None)], "id string, canonical_name string, entity_type string, organism string")
    synonyms = spark.createDataFrame([("1", "alpha"), ("2", "beta long name"), ("2", "second beta of that kind"), ("3", "tp9")], "entity_id string, synonym string")
    asked = spark.createDataFrame([("a", "none", ["", "Beta long name", "alpha"], "protein", None), ("b", "tumor nine", [], "gene", None), ("c", "second beta of that kinds", None, "metabolite", None), ("d", "odd", ["Odd one"], "gene", None)], "mention string, name string, synonyms array<string>, entity_type string, organism string")
    answers = spark.createDataFrame([("b", "TP9", "P9", ["TP9", "other"]), ("d", "ODD1", "P8", ["ODD1"])], "mention string, canonical_name string, accession string, names array<string>")
    found = resolve.cascade(asked, entities, synonyms, answers)
    assert {r.mention: (r.entity_id, r.how) for r in found.collect()} == {"a": ("2", "exact:unique"), "b": ("3", "resolved:unique"), "c": ("2", "fuzzy"), "d": ("new:gene_protein:odd1", "created")}
    learned = {(r.entity_id, r.synonym) for r in resolve.learn_synonyms(found.where("mention = 'a'"), asked, synonyms).collect()}
    assert learned == {("2", "none"), ("2", "alpha")}
    new, names = resolve.created(asked, found)
    assert [r.id for r in new.collect()] == ["new:gene_protein:odd1"] and {r.synonym for r in names.collect()} == {"odd", "odd one"}


def test_names_for_graph_calls(spark):
    synonyms = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b")], "entity_id string, synonym string")
    assert lookups.entity_of(synonyms, " A ") == "1" and lookups.entity_of(synonyms, "b", strict=False) is None
    for name, error in (("b", lookups.AmbiguousName), ("zz", lookups.NameNotFound)):
        with pytest.raises(error):
            lookups.entity_of(synonyms, name)
    with pytest.raises(ValueError):
        lookups.different_ends("1", "1")


def test_articles_walk_bodies_once():
    xml = "<a xmlns='x'><front><article-title>T <i>i</i></article-title></front><body><p>one<fig><p>no</p></fig> two</p><sec><title>H</title><sec><p>deep</p></sec></sec><formula>no</formula><def-list><def-item><term>t</term><def><p>d</p></def></def-item></def-list></body></a>"
    assert entries.article_text(xml) == "TITLE: T i\n\none two\n\nH\n\ndeep\n\nt\n\nd\n\nd"
    assert entries.article_text("<a><b></a>") == entries.article_text("<a/>") == "" and entries.article_text("no markup") is None


def test_broken_articles_are_recovered():
    """What is well formed reads alike by both ways; what isn't keeps all that stands before and behind the break."""
    whole = "<a><front><article-title>T &amp; <i>i</i></article-title><abstract>A</abstract></front><body><p>one<fig><p>no</p></fig> two</p><sec><title>H</title><p>deep</p></sec></body></a>"
    want = entries.article_text(whole)
    root = entries.recovered(whole)
    assert [(e.tag, e.text, e.tail) for e in root.iter()] == [(e.tag, e.text, e.tail) for e in entries.ElementTree.fromstring(whole).iter()]
    for broken in (whole[:-4], whole[:-11], whole.replace("<i>i</i>", "<i>i"), whole.replace("</p><sec>", "</p></q></z><sec>"), whole.replace("<sec>", "<sec><!-- <p>no</p> -->").removesuffix("</a>"), whole.replace("&amp;", "&"), f"{whole}<p>after</p>", "<?xml version='1.0'?><!DOCTYPE a>" + whole.replace("<a>", "<j:a>").replace("</a>", "</j:a>")):
        assert entries.article_text(broken) == want, broken
    assert entries.article_text("<a><body><p>1 < 2 <![CDATA[<b> & c]]> d") == "1 < 2 <b> & c d"
    assert entries.article_text("<a " * 20_000 + "<body><p>x") == "x"
    assert entries.article_text("<a><body>" + "<sec>" * 5_000 + "<p>deep") == "deep"


def test_entries_without_names(spark):
    rows = spark.createDataFrame([('{"primaryAccession": "P1"}',), ('{"primaryAccession": "P2", "genes": [{"synonyms": [{"value": "s"}, {"value": "S"}]}]}',)], "entry string")
    assert {r.accession: (r.canonical_name, r.synonyms) for r in entries.entry_entities(rows).collect()} == {"P1": ("P1", []), "P2": ("s", ["s"])}


def test_null_keys_never_conflict(spark):
    old = spark.createDataFrame([("a", None, "1"), ("b", "human", "2")], "name string, organism string, id string")
    new = spark.createDataFrame([("a", None, "3"), ("b", "human", "4")], "name string, organism string, id string")
    assert sorted(r.id for r in resolve.upsert(old, new, ["name", "organism"], F.col("id")).collect()) == ["1", "2", "3"]


def test_written_copies_can_be_cleaned(spark):
    from pathlib import Path

    from claimweave import session

    kept, session.WRITTEN[spark.sparkContext.applicationId] = session.WRITTEN.get(spark.sparkContext.applicationId, []), []  # other tests' copies stay
    copy = session.materialize(spark.range(3), "mine")
    files = copy.inputFiles()
    assert copy.count() == 3 and session.clean(spark) == 1 and session.clean(spark) == 0
    session.WRITTEN[spark.sparkContext.applicationId] = kept
    assert not Path(files[0].removeprefix("file://")).exists()
