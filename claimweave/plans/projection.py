"""The graph model's tables, derived from the star schema.

Each table is one statement that Spark and other SQL engines read alike; names in braces are tables. Evidence and interactions
are built from the keys of the star schema instead (see keyed), with the rows of their statements.
``Model`` gives them as DataFrames over a folder of Parquet tables; ``with_tables`` gives the same
as common table expressions before a query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from claimweave.plans import keyed
from claimweave.session import materialize

PROJECTION = {
    "entities": """
SELECT concat('s', CAST(s_suppkey AS STRING)) AS id, s_name AS canonical_name, 'protein' AS entity_type, n_name AS organism,
  CAST(floor(abs(s_acctbal) / 100) AS BIGINT) AS paper_count FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), p_name, CASE WHEN p_size % 2 = 0 THEN 'gene' ELSE 'metabolite' END, CAST(NULL AS STRING), CAST(p_size AS BIGINT) FROM {part}
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), c_name, 'pathway', n_name, CAST(floor(abs(c_acctbal) / 1000) AS BIGINT) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "synonyms": """
SELECT id AS entity_id, lower(trim(canonical_name)) AS synonym FROM {entities}
UNION SELECT concat('p', CAST(p_partkey AS STRING)), lower(concat(p_brand, ' ', p_name)) FROM {part}""",
    "papers": """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS id, CAST(year(o_orderdate) AS INT) AS year, o_orderdate AS created_at, o_orderpriority AS priority, o_orderstatus AS status, o_custkey AS source_key FROM {orders}""",
    "claims": """
SELECT concat('s', CAST(l_suppkey AS STRING)) AS entity_a, concat('p', CAST(l_partkey AS STRING)) AS entity_b,
  CASE l_linenumber % 3 WHEN 0 THEN 'transcriptional' WHEN 1 THEN 'post_translational' ELSE 'direct_binding' END AS interaction_type,
  CASE l_returnflag WHEN 'A' THEN 'activates' WHEN 'R' THEN 'inhibits' ELSE 'binds' END AS effect,
  CASE WHEN l_linenumber = 7 THEN 'undirected' WHEN l_linenumber = 6 THEN 'bidirectional' WHEN l_linestatus = 'O' THEN 'A_to_B' ELSE 'B_to_A' END AS direction,
  concat('o', CAST(l_orderkey AS STRING)) AS paper_id, l_linenumber AS line_no,
  CASE l_linenumber WHEN 1 THEN 'structural' WHEN 2 THEN 'in_vivo' WHEN 3 THEN 'in_vitro' WHEN 4 THEN 'curated_db' WHEN 5 THEN 'computational' WHEN 6 THEN 'cited_claim' ELSE 'unknown' END AS evidence_type,
  l_quantity / CAST(50 AS DOUBLE) AS confidence_score, l_discount * CAST(10 AS DOUBLE) AS verification_score,
  CASE WHEN l_tax = 0 THEN CAST(NULL AS STRING) ELSE concat(l_returnflag, l_linestatus, ' ', CAST(l_partkey AS STRING)) END AS snippet, l_extendedprice AS price
FROM {lineitem}""",
    "evidence": """
SELECT interaction_id, concat(interaction_id, '@', paper_id) AS id, entity_a, entity_b, interaction_type, effect, direction, paper_id, evidence_type, confidence_score, verification_score, snippet, year,
  CASE n_regionkey WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'mouse' WHEN 2 THEN 'Rattus norvegicus' WHEN 3 THEN 'Danio rerio' ELSE CAST(NULL AS STRING) END AS organism,
  CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(NULL AS STRING) ELSE lower(c_mktsegment) END AS tissue_cell_type,
  CASE WHEN priority LIKE '1%' THEN 'hypoxic stress' WHEN priority LIKE '5%' THEN CAST(NULL AS STRING) ELSE lower(priority) END AS condition
FROM (SELECT c.*, concat(entity_a, '|', entity_b, '|', interaction_type, '|', effect, '|', direction) AS interaction_id,
  row_number() OVER (PARTITION BY entity_a, entity_b, interaction_type, effect, direction, paper_id ORDER BY line_no, confidence_score DESC, price, verification_score, snippet NULLS FIRST) AS arrival FROM {claims} c) e
JOIN {papers} p ON p.id = e.paper_id JOIN {customer} ON c_custkey = source_key JOIN {nation} ON n_nationkey = c_nationkey WHERE arrival = 1""",
    "searches": """
SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'conflict_resolution' WHEN 'view' THEN 'entity_expansion' ELSE 'gap_filling' END AS query_type,
  CASE event_type WHEN 'error' THEN 'conflict' WHEN 'view' THEN 'entity' WHEN 'click' THEN 'interaction' ELSE CAST(NULL AS STRING) END AS target_kind,
  CASE WHEN user_id % 2 = 0 THEN 'seed' ELSE 'sparse_high_value_entity' END AS generation_reason, concat('s', CAST(user_id AS STRING)) AS target_id,
  CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'running' ELSE 'done' END AS status, ts AS completed_at,
  CAST(floor(value) AS BIGINT) AS papers_new, CAST(floor(value / 10) AS BIGINT) AS new_evidence, CAST(floor(value / 25) AS BIGINT) AS new_interactions, CASE WHEN value > 50 THEN 1 ELSE 0 END AS improved
FROM {events}""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


#: What is written once for many queries, by application, folder and name.
STORED: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    STORED.clear()


class Model:
    """The graph model over ``sf_dir``: its tables by name, each read or derived when first asked for.

    Of a stored model evidence, interactions and synonyms (in order, so that a prefix reads few of them) are written, each when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, is_stored: bool = False):
        self.spark, self.sf_dir, self.known, self.is_stored = spark, sf_dir, {}, is_stored

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = self._table(name)
        return self.known[name]

    def _table(self, name: str) -> DataFrame:
        if name == "evidence":
            build = lambda: keyed.pieces(self._claims(), self._papers())
            return keyed.evidence(self.kept("pieces", build) if self.is_stored else build())
        if name not in PROJECTION:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = PROJECTION[name]
        table = self.spark.sql(text, **{t: self[t] for t in (*BASE, *PROJECTION) if f"{{{t}}}" in text})
        if name == "synonyms" and self.is_stored:
            return self.kept(name, lambda: table.repartitionByRange("synonym").sortWithinPartitions("synonym"))
        return table

    def _claims(self) -> DataFrame:
        return keyed.lines(self["lineitem"])

    def _papers(self) -> DataFrame:
        return keyed.papers(self["orders"], self["customer"], self["nation"])

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` gives, written once a folder and application, for queries that read it many times.

        The folder's tables don't change meanwhile; forget() drops what was written."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in STORED:
            STORED[key] = materialize(build(), name)
        return STORED[key]

    def stored(self) -> Model:
        return self if self.is_stored else self._stored

    @cached_property
    def _stored(self) -> Model:
        return Model(self.spark, self.sf_dir, True)

    @cached_property
    def contested(self) -> Model:
        """The model of those claims alone whose pair of entities and type has several interactions: all that a conflict can be between. It is written."""
        part = Model(self.spark, self.sf_dir)
        pieces = self.kept("contested", lambda: keyed.contested(self._claims(), self["orders"], self["customer"], self["nation"]))
        part.known["evidence"] = keyed.evidence(pieces)
        part.every = keyed.interactions(self.kept("contested-sums", lambda: keyed.contested_sums(pieces)))
        return part

    @cached_property
    def every(self) -> DataFrame:
        """The interactions, with ``curated``, the number of their pieces of evidence from a curated source."""
        build = lambda: keyed.sums(self._claims(), self._papers())
        return keyed.interactions(self.kept("interactions", build) if self.is_stored else build())

    @property
    def interactions(self) -> DataFrame:
        return self.every.drop("curated")


#: The SQL of operators that other operators' SQL builds on.
DERIVED = {
    "interactions": """
SELECT interaction_id AS id, entity_a, entity_b, interaction_type, effect, direction, evidence_count, round(raw_score, 4) AS score,
  CASE WHEN evidence_count >= 3 AND raw_score >= 0.5 OR raw_score >= 0.65 OR evidence_count >= 2 AND raw_score >= 0.55 THEN 'high' WHEN raw_score >= 0.4 THEN 'medium' ELSE 'low' END AS label
FROM (SELECT interaction_id, entity_a, entity_b, interaction_type, effect, direction, CAST(count(*) AS BIGINT) AS evidence_count, sum(confidence_score * w) / sum(w) AS raw_score
  FROM (SELECT e.*, CASE evidence_type WHEN 'structural' THEN CAST(1.5 AS DOUBLE) WHEN 'in_vivo' THEN CAST(1.3 AS DOUBLE) WHEN 'in_vitro' THEN CAST(1.0 AS DOUBLE) WHEN 'curated_db' THEN CAST(0.9 AS DOUBLE) WHEN 'genetic_screen' THEN CAST(0.9 AS DOUBLE)
    WHEN 'clinical' THEN CAST(1.1 AS DOUBLE) WHEN 'co_expression' THEN CAST(0.6 AS DOUBLE) WHEN 'computational' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS w FROM {evidence} e) q
  GROUP BY interaction_id, entity_a, entity_b, interaction_type, effect, direction) r""",
}


def with_tables(query: str, **more: str) -> str:
    """``query``, with the tables that it names before it; ``more`` are further named statements."""
    every = PROJECTION | DERIVED | more
    order: list[str] = []

    def visit(text: str) -> None:
        for name in every:
            if f"{{{name}}}" in text and name not in order:
                visit(every[name])
                order.append(name)

    visit(query)
    plain = lambda text: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in (*BASE, *every) else m[0], text)
    return ("WITH " + ", ".join(f"{n} AS ({plain(every[n])})" for n in order) + " " if order else "") + plain(query)
