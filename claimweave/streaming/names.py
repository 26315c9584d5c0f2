"""Live names: a stream of mentions resolved against the candidates of their name, which the stream itself keeps up.

The state of a name is its candidates by entity. Rows that teach (kind learn) add to it or replace what is known of the entity; rows
that ask are resolved by the same rungs as a batch (resolve.RUNGS). The only candidate decides alone until a second entity
has the name. A mention whose name nobody has becomes an entity, which later mentions see, in the same micro-batch too. Candidates that nothing
has taught for the time to live are forgotten. Names are dealt by key, so the state grows with the names over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimweave.operators.resolve import RUNGS

ROWS = "kind string, name string, mention string, entity_id string, entity_type string, organism string, canonical_name string, place long"
OUT = "key string, mention string, entity_id string, rung string, candidates int"
#: Settings of a session that runs live(): the store that keyed state of this kind needs, and no batches without data, of which a time to live would ask for ever more.
PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

Candidate = tuple[str | None, str | None, str | None]


def low(text: str | None) -> str | None:
    return (text or "").strip().lower() or None


def group(kind: str | None) -> str | None:
    return "gene_protein" if kind in ("gene", "protein") else kind


def decide(key: str, kind: str | None, organism: str | None, known: dict[str, Candidate]) -> tuple[str | None, str | None]:
    """(entity_id, rung) of a mention: the first rung that leaves one of the candidates."""
    organism = low(organism)
    rules = {
        "unique": lambda c: True,
        "type_organism": lambda c: kind is not None and c[0] == kind and organism is not None and low(c[1]) == organism,
        "organism": lambda c: organism is not None and low(c[1]) == organism,
        "type": lambda c: kind is not None and c[0] == kind,
        "group": lambda c: kind is not None and group(c[0]) == group(kind),
        "canonical": lambda c: low(c[2]) == key,
    }
    for rung in RUNGS:
        left = [i for i, c in known.items() if rules[rung](c)]
        if len(left) == 1:
            return left[0], rung
    return None, None


class Names(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("candidates", "entity_id string", "entity_type string, organism string, canonical_name string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, known = key[0], {i[0]: tuple(c) for i, c in self.known.iterator()}
        every = pd.concat(list(rows)).sort_values(["place", "kind", "mention", "entity_id"], ascending=[True, False, True, True], na_position="first")  # at equal places those that teach go first
        every = every.astype(object).where(every.notna(), None)
        out = []
        for r in every.itertuples():
            if r.kind == "learn":
                known[r.entity_id] = (r.entity_type, r.organism, r.canonical_name)
                self.known.updateValue((r.entity_id,), known[r.entity_id])
                continue
            found, rung = decide(name, r.entity_type, r.organism, known)
            if not known:
                found, rung = f"new:{group(r.entity_type)}:{name}", "created"
                known[found] = (r.entity_type, r.organism, r.name.strip())
                self.known.updateValue((found,), known[found])
            out.append((name, r.mention, found, rung, len(known)))
        yield pd.DataFrame(out, columns=["key", "mention", "entity_id", "rung", "candidates"])

    def close(self) -> None:
        pass


def live(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(key, mention, entity_id, rung, candidates) of each asking row of ROWS, in order of ``place`` within a micro-batch; empty names are left out.

    An ambiguous mention has a null entity. ``keep_ms`` is the time to live of a candidate since it was last taught; none: for ever. The session has PROVIDER."""
    keyed = rows.withColumn("key", F.lower(F.trim("name"))).where("key != ''")
    mode = "None" if keep_ms is None else "ProcessingTime"
    return keyed.groupBy("key").transformWithStateInPandas(statefulProcessor=Names(keep_ms), outputStructType=OUT, outputMode="Append", timeMode=mode)


def taught(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Stored entities and synonyms as rows that teach: what a stream begins with, or a rebuilt state after a loss."""
    every = synonyms.select("entity_id", F.col("synonym").alias("name")).join(entities.select(F.col("id").alias("entity_id"), "entity_type", "organism", "canonical_name"), "entity_id")
    none = F.lit(None).cast("string")
    return every.select(F.lit("learn").alias("kind"), "name", none.alias("mention"), "entity_id", "entity_type", "organism", "canonical_name", F.lit(-1).cast("long").alias("place"))
