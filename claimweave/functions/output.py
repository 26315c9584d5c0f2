"""Model output: calls in several written forms to one JSON object, and its validation as rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text, vocab

LEAST_SNIPPET, MOST_SNIPPET, SIMILAR = 20, 400, 0.75
CALL = re.compile(r"(?s)<tool_call>(.*?)(?:</tool_call>|$)")
FUNCTION = re.compile(r"(?s)<function=[^>]+>(.*?)(?:</function>|$)")
PARAMETER = re.compile(r"(?s)<parameter=([^>]+)>(.*?)</parameter>")


def _value(raw: str):
    try:
        return json.loads(raw)
    except ValueError:
        return raw


def arguments(said: str | None) -> str | None:
    """The arguments of the call in some output as JSON, or null.

    Forms in turn: named parameters in a function element, each decoded where it is JSON; a call
    element with a JSON object, whose ``arguments`` (an object, or one as text) count, or itself if it has
    entities or interactions; else the first JSON object in the text, repaired."""
    if said is None:
        return None
    bare = re.sub(r"(?s)<think>.*?</think>", "", said)
    named = FUNCTION.search(bare)
    if named and (own := {k.strip(): _value(v.strip()) for k, v in PARAMETER.findall(named[1])}):
        return json.dumps(own, sort_keys=True, ensure_ascii=False)
    for call in CALL.findall(bare):
        whole = text.repaired(call)
        if isinstance(whole, dict):
            inner = whole.get("arguments")
            inner = _value(inner) if isinstance(inner, str) else inner
            chosen = inner if isinstance(inner, dict) else whole if {"entities", "interactions"} & whole.keys() else None
            if chosen is not None:
                return json.dumps(chosen, sort_keys=True, ensure_ascii=False)
    return text.repair(bare)


def parse_calls(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``parsed``, see arguments()."""
    @F.pandas_udf("string")
    def run(said: pd.Series) -> pd.Series:
        return said.map(arguments)

    return rows.withColumn("parsed", run(column))


FIELDS = ("entity_a", "entity_b", "interaction_type", "direction", "effect", "evidence_type", "organism", "tissue_cell_type", "condition", "assay_type", "confidence", "confidence_score", "snippet", "reasoning")
INTERACTION = ", ".join(f"{f} string" for f in FIELDS)


def _items(field: str) -> Column:
    """The objects in a list of the parsed output, each as JSON; none if the field isn't a list."""
    raw = F.get_json_object("parsed", f"$.{field}")
    return F.filter(F.coalesce(F.from_json(F.when(F.startswith(raw, F.lit("[")), raw), "array<string>"), F.array().cast("array<string>")), lambda x: F.startswith(x, F.lit("{")))


def plain(value: Column, default: str) -> Column:
    """Lower case, blanks and hyphens as underscores; the default for nothing."""
    return F.coalesce(F.nullif(F.translate(vocab.strip(F.lower(value)), " -", "__"), F.lit("")), F.lit(default))


def entities(rows: DataFrame) -> DataFrame:
    """(paper_id, name, entity_type, synonyms, organism) of the parsed outputs; entries without a name go."""
    each = rows.select("paper_id", F.explode(_items("entities")).alias("x")).select("paper_id", F.from_json("x", "name string, entity_type string, synonyms array<string>, organism string").alias("e"))
    none = F.array().cast("array<string>")
    return each.where("e.name IS NOT NULL").select("paper_id", "e.name", vocab.enum(F.col("e.entity_type"), vocab.ENTITY_ALIASES).alias("entity_type"), F.coalesce("e.synonyms", none).alias("synonyms"), "e.organism")


def interactions(rows: DataFrame) -> DataFrame:
    """The interactions of the parsed outputs (paper_id, parsed, text), validated.

    Those without both names, and those of organisms that aren't mammals, go. A score that isn't a
    number is 0.3, others are put within 0 to 1. A snippet of LEAST_SNIPPET characters or more that the text
    doesn't support makes the confidence low and the score 0.3 at most. Snippets are cut to MOST_SNIPPET."""
    each = rows.select("paper_id", "text", F.explode(_items("interactions")).alias("x")).select("paper_id", "text", F.from_json("x", INTERACTION).alias("i"))
    each = each.select("paper_id", "text", "i.*").where("entity_a != '' AND entity_b != ''").where(~vocab.non_mammalian(F.col("organism")))
    each = text.snippets_supported(each.withColumn("snippet", F.coalesce("snippet", F.lit(""))), SIMILAR)
    doubted = (F.length("snippet") >= LEAST_SNIPPET) & ~F.col("found")
    score = vocab.clamp(F.coalesce("confidence_score", F.lit("0.3")))
    unsure = F.least(vocab.clamp(F.coalesce("confidence_score", F.lit("0.5"))), F.lit(0.3))
    level = plain(F.col("confidence"), "low")
    return each.select(
        "paper_id", "entity_a", "entity_b", vocab.enum(F.col("interaction_type"), vocab.INTERACTION_ALIASES).alias("interaction_type"), plain(F.col("direction"), "undirected").alias("direction"),
        F.nullif("effect", F.lit("")).alias("effect"), plain(F.col("evidence_type"), "unknown").alias("evidence_type"), "organism", "tissue_cell_type", "condition", "assay_type",
        F.when(doubted | ~level.isin("high", "medium", "low"), "low").otherwise(level).alias("confidence"), F.when(doubted, unsure).otherwise(score).alias("confidence_score"),
        F.left("snippet", F.lit(MOST_SNIPPET)).alias("snippet"), F.coalesce("reasoning", F.lit("")).alias("reasoning"),
    )
