"""Names kept by a stream against a rebuilt state, and across batches."""

import random

import pytest

from claimweave.operators import resolve
from claimweave.streaming import names


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in names.PROVIDER}
    for k, v in names.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def run(spark, folder, batches, keep_ms=None):
    """The answers of a stream over the batches, one file each, and a restart between them."""
    out = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, names.ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        table = f"answers{random.randrange(10**9)}"
        stream = names.live(spark.readStream.schema(names.ROWS).parquet(f"{folder}/in"), keep_ms)
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = {r.mention: (r.entity_id, r.rung, r.candidates) for r in spark.read.schema(names.OUT).parquet(f"{folder}/out").collect()}
        out[n] = {m: v for m, v in seen.items() if all(m not in o for o in out.values())}
    return out


def learn(name, entity, kind, organism=None, canonical=None, place=0):
    return ("learn", name, None, entity, kind, organism, canonical or name, place)


def ask(name, mention, kind=None, organism=None, place=1):
    return ("ask", name, mention, None, kind, organism, None, place)


def test_later_batches_see_earlier_ones(stateful, tmp_path):
    first = [learn("TP53", "e1", "gene", "human"), ask(" tp53 ", "m1"), ask("brandnew", "m2", "protein", place=1), ask("BrandNew ", "m3", place=2), ask("  ", "m0")]
    second = [ask("tp53", "n1"), learn("tp53", "e2", "gene", "mouse", place=2), ask("tp53", "n2", place=3), ask("tp53", "n3", "gene", "MOUSE ", place=4), ask("brandnew", "n4", "gene")]
    got = run(stateful, str(tmp_path), [first, second])
    assert got[0] == {"m1": ("e1", "unique", 1), "m2": ("new:gene_protein:brandnew", "created", 1), "m3": ("new:gene_protein:brandnew", "unique", 1)}
    # the only candidate decides until another entity has the name, and organisms tell them apart from then on
    assert got[1] == {"n1": ("e1", "unique", 1), "n2": (None, None, 2), "n3": ("e2", "type_organism", 2), "n4": ("new:gene_protein:brandnew", "unique", 1)}


def test_the_state_equals_a_rebuild(stateful, tmp_path):
    """Many names of several entities, taught over batches: the answers are those of a batch over all that was stored."""
    rng = random.Random(6)
    kinds, organisms = ["gene", "protein", "metabolite", None], ["human", "Mouse", None, ""]
    entities = [(f"e{i}", rng.choice(["aa", "bb", "cc", "dd"]), rng.choice(kinds[:3]), rng.choice(organisms)) for i in range(14)]
    synonyms = sorted({(e[0], rng.choice(["aa", "bb", "cc", "dd", "ee"])) for e in entities for _ in range(2)})
    of = {e[0]: e for e in entities}
    taught = [("learn", s, None, i, of[i][2], of[i][3], of[i][1], 0) for i, s in synonyms]
    mentions = [(f"m{k}", rng.choice(["AA", " bb", "cc", "dd", "ee"]), rng.choice(kinds), rng.choice(organisms)) for k in range(60)]
    asked = [("ask", n, m, None, t, o, None, 5) for m, n, t, o in mentions]
    got = run(stateful, str(tmp_path), [taught[::2], taught[1::2], asked])[2]
    table = stateful.createDataFrame(entities, "id string, canonical_name string, entity_type string, organism string")
    names_of = stateful.createDataFrame(synonyms, "entity_id string, synonym string")
    whole = resolve.exact(stateful.createDataFrame(mentions, "mention string, name string, entity_type string, organism string"), table, names_of).collect()
    assert {m: v[:2] for m, v in got.items() if v[0]} == {r.mention: (r.entity_id, r.rung) for r in whole} and len(got) == 60
    rebuilt = [tuple(r) for r in names.taught(table, names_of).collect()]
    assert run(stateful, str(tmp_path / "again"), [rebuilt + asked])[0] == got


def test_candidates_expire(stateful, tmp_path):
    import time

    folder = str(tmp_path)
    assert run(stateful, folder, [[learn("x", "e1", "gene"), ask("x", "m1")]], 2_000)[0]["m1"][0] == "e1"
    time.sleep(3)
    assert run(stateful, folder, [[ask("x", "m2", "metabolite")]], 2_000)[0]["m2"] == ("new:metabolite:x", "created", 1)
