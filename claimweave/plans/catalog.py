"""All registered queries of the claim-graph operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text, vocab
from claimweave.operators import confidence, conflicts, graph, history, lookups, planner, resolve
from claimweave.plans import graph_sql
from claimweave.plans.projection import Model, with_tables
from claimweave.session import materialize
from claimweave.sources import sinks, tabular
from claimweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Callable[[Model], DataFrame], str | None]] = {}


def entry(name: str, sql: str | None = None, **tables: str):
    """Register a query over the model; its SQL is completed with the tables that it names."""
    def keep(build: Callable[[Model], DataFrame]):
        ENTRIES[name] = (build, with_tables(sql, **tables) if sql else None)
        return build

    return keep


def queries() -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, build=build: build(Model(spark, sf_dir))) for name, (build, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}


# --- evidence and confidence -------------------------------------------------------------------

entry("confidence_composite", "SELECT * FROM {interactions}")(lambda m: m.interactions)
entry("confidence_top", "SELECT * FROM {interactions} ORDER BY score DESC, evidence_count DESC, id LIMIT 50")(lambda m: confidence.strongest(m.interactions, 50))

CONTEXTS = """SELECT e.*, CASE organism WHEN 'Homo sapiens' THEN 'human' WHEN 'mouse' THEN 'mouse' WHEN 'Rattus norvegicus' THEN 'rat' WHEN 'Danio rerio' THEN 'organism:danio_rerio' END AS norm_organism,
 CASE WHEN tissue_cell_type IS NOT NULL THEN concat('context:', tissue_cell_type) END AS norm_tissue,
 CASE WHEN condition IS NULL THEN NULL WHEN condition LIKE '%hypoxic%' THEN 'hypoxia' ELSE concat('condition:', trim(regexp_replace(condition, '[^a-z0-9]+', '_', 'g'), '_')) END AS norm_condition FROM {evidence} e"""
ADJUDICATED = """SELECT *, round(q * 0.35::DOUBLE + v * 0.3::DOUBLE + d * 0.15::DOUBLE + c * 0.1::DOUBLE + r * 0.1::DOUBLE, 4) AS adjudication_score FROM (SELECT x.*,
 CASE evidence_type WHEN 'structural' THEN 1.0::DOUBLE WHEN 'in_vivo' THEN 0.9::DOUBLE WHEN 'clinical' THEN 0.85::DOUBLE WHEN 'in_vitro' THEN 0.75::DOUBLE WHEN 'curated_db' THEN 0.7::DOUBLE WHEN 'genetic_screen' THEN 0.65::DOUBLE WHEN 'co_expression' THEN 0.45::DOUBLE
   WHEN 'computational' THEN 0.35::DOUBLE WHEN 'cited_claim' THEN 0.35::DOUBLE ELSE 0.3::DOUBLE END AS q,
 CASE WHEN coalesce(verification_score, 0) = 0 THEN 0.4::DOUBLE ELSE verification_score END AS v, CASE WHEN coalesce(snippet, '') <> '' THEN 0.85::DOUBLE ELSE 0.3::DOUBLE END AS d,
 0.1::DOUBLE + CASE WHEN norm_organism IS NOT NULL THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN norm_tissue IS NOT NULL THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN norm_condition IS NOT NULL THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS c,
 CASE WHEN year >= 2022 THEN 1.0::DOUBLE WHEN year >= 2018 THEN 0.8::DOUBLE WHEN year >= 2010 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS r FROM {contexts} x) y"""
SUMMARY = """SELECT interaction_id, CAST(count(*) AS BIGINT) AS n, floor((sum(CAST(round(adjudication_score * 10000) AS BIGINT)) + count(*) / 2.0::DOUBLE) / count(*)) / 10000.0::DOUBLE AS mean_score, round(max(adjudication_score), 4) AS max_score, floor((sum(CAST(round(coalesce(verification_score, 0) * 10000) AS BIGINT)) + count(*) / 2.0::DOUBLE) / count(*)) / 10000.0::DOUBLE AS mean_verification,
 list_sort(list_distinct(list(ctx) FILTER (WHERE ctx IS NOT NULL))) AS contexts, arg_min(paper_id, struct_pack(a := -adjudication_score, b := id)) AS best_paper_id
 FROM (SELECT *, nullif(concat_ws('|', norm_organism, norm_tissue, norm_condition), '') AS ctx FROM {adjudicated}) q GROUP BY interaction_id"""
EV = {"contexts": CONTEXTS, "adjudicated": ADJUDICATED, "summary": SUMMARY}


def adjudicated(m: Model) -> DataFrame:
    return m.kept("adjudicated", lambda: confidence.adjudicate(confidence.with_contexts(m.stored()["evidence"])))


entry("evidence_contexts", "SELECT id, norm_organism, norm_tissue, norm_condition FROM {contexts}", **EV)(lambda m: confidence.with_contexts(m["evidence"]).select("id", "norm_organism", "norm_tissue", "norm_condition"))
entry("evidence_adjudication", "SELECT id, adjudication_score, printf('quality=%.2f; verification=%.2f; directness=%.2f; context=%.2f; recency=%.2f', q, v, d, c, r) AS note FROM {adjudicated}", **EV)(lambda m: adjudicated(m).select("id", "adjudication_score", "note"))
entry("evidence_summary", "SELECT interaction_id, n, mean_score, max_score, mean_verification, coalesce(array_to_string(contexts, ';'), '') AS contexts, best_paper_id FROM {summary}", **EV)(
    lambda m: confidence.summarise(adjudicated(m)).withColumn("contexts", F.array_join("contexts", ";"))
)
entry("evidence_lines", """SELECT interaction_id, CAST(place AS INT) AS place, concat(paper_id, ' | ', evidence_type, ' | ', printf('%.2f', confidence_score)) AS line
 FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY adjudication_score DESC, id) AS place FROM {adjudicated}) q WHERE place <= 5""", **EV)(lambda m: confidence.first_lines(adjudicated(m)))  # fmt: skip
entry("claim_dedup", """SELECT a, b, kind, effect, direction, snippet, confidence_score, paper_id FROM (SELECT lower(entity_a) AS a, lower(entity_b) AS b, interaction_type AS kind, lower(effect) AS effect, direction, trim(coalesce(snippet, '')) AS snippet, confidence_score, paper_id,
 row_number() OVER (PARTITION BY lower(entity_a), lower(entity_b), interaction_type, lower(effect), direction, trim(coalesce(snippet, '')) ORDER BY confidence_score DESC, paper_id, line_no) AS r FROM {claims}) q WHERE r = 1""")(lambda m: confidence.dedup_claims(m["claims"]))  # fmt: skip
entry("score_percentiles", """SELECT label, CAST(n AS BIGINT) AS n, s[1 + least(n * 50 // 100, n - 1)] AS p50, s[1 + least(n * 95 // 100, n - 1)] AS p95, s[1 + least(n * 99 // 100, n - 1)] AS p99
 FROM (SELECT label, count(*) AS n, list(score ORDER BY score) AS s FROM {interactions} GROUP BY label) q""")(lambda m: confidence.percentiles(m.interactions, "label", "score"))  # fmt: skip

# --- search, degree, counts --------------------------------------------------------------------

entry("entity_search", """SELECT id, canonical_name, entity_type, paper_count, synonym AS matching_synonym, CAST(rank AS INT) AS rank FROM (SELECT e.*, s.synonym, CASE WHEN s.synonym = 'red' THEN 0 ELSE 1 END AS rank,
 row_number() OVER (PARTITION BY e.id ORDER BY CASE WHEN s.synonym = 'red' THEN 0 ELSE 1 END, s.synonym) AS r FROM {synonyms} s JOIN {entities} e ON e.id = s.entity_id WHERE starts_with(s.synonym, 'red')) q WHERE r = 1 ORDER BY rank, paper_count DESC, id LIMIT 50""")(lambda m: lookups.search(m["entities"], m.stored()["synonyms"], "Red"))  # fmt: skip
entry("synonym_candidates", "SELECT * FROM {entities} WHERE id IN (SELECT entity_id FROM {synonyms} WHERE synonym = 'red widget')")(lambda m: lookups.synonym_candidates(m["entities"], m["synonyms"], "Red Widget "))
ENDS = "SELECT entity_a AS entity, id FROM {interactions} UNION ALL SELECT entity_b, id FROM {interactions}"
DEGREE = "SELECT entity, CAST(count(*) AS BIGINT) AS degree FROM {ends} GROUP BY entity"
DEG = {"ends": ENDS, "degrees": DEGREE}
entry("degree", "SELECT * FROM {degrees}", **DEG)(lambda m: lookups.degree(m.stored().interactions))
entry("degree_by_direction", """SELECT entity, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS total_degree FROM (
 SELECT entity_a AS entity, CASE WHEN upper(direction) IN ('A_TO_B', 'BIDIRECTIONAL') THEN 1 ELSE 0 END AS o, CASE WHEN upper(direction) IN ('B_TO_A', 'BIDIRECTIONAL') THEN 1 ELSE 0 END AS i FROM {interactions}
 UNION ALL SELECT entity_b, CASE WHEN upper(direction) IN ('B_TO_A', 'BIDIRECTIONAL') THEN 1 ELSE 0 END, CASE WHEN upper(direction) IN ('A_TO_B', 'BIDIRECTIONAL') THEN 1 ELSE 0 END FROM {interactions}) q GROUP BY entity""")(lambda m: lookups.direction_degree(m.stored().interactions))  # fmt: skip
entry("top_degree", "SELECT e.id, e.canonical_name, CAST(count(*) AS BIGINT) AS degree FROM (SELECT DISTINCT entity, id FROM {ends}) x JOIN {entities} e ON e.id = x.entity GROUP BY e.id, e.canonical_name ORDER BY degree DESC, e.id LIMIT 50", **DEG)(lambda m: lookups.top_degree(m["entities"], m.stored().interactions, 50))
entry("sparse_entities", "SELECT e.id, e.canonical_name, e.paper_count, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM {entities} e LEFT JOIN {degrees} d ON d.entity = e.id WHERE coalesce(d.degree, 0) < 25 ORDER BY paper_count DESC, degree, id LIMIT 20", **DEG)(lambda m: lookups.sparse_entities(m["entities"], m.interactions, 25, 20))
entry("low_interaction_entities", "SELECT e.id, e.canonical_name FROM {entities} e LEFT JOIN {degrees} d ON d.entity = e.id WHERE coalesce(d.degree, 0) < 3 ORDER BY e.id LIMIT 20", **DEG)(lambda m: lookups.low_interaction(m["entities"], m.interactions, 3, 20))
entry("synonym_overlaps", """SELECT synonym, CAST(count(DISTINCT e.id) AS BIGINT) AS n_entities, string_agg(DISTINCT e.id, ',' ORDER BY e.id) AS ids, string_agg(DISTINCT e.entity_type, ',' ORDER BY e.entity_type) AS types, CAST(sum(paper_count) AS BIGINT) AS total_paper_count
 FROM {synonyms} s JOIN {entities} e ON e.id = s.entity_id GROUP BY synonym HAVING count(DISTINCT e.id) > 1 ORDER BY n_entities DESC, total_paper_count DESC, synonym LIMIT 50""")(lambda m: lookups.synonym_overlaps(m["entities"], m["synonyms"]))  # fmt: skip
entry("synonym_overlap_total", "SELECT CAST(count(*) AS BIGINT) AS overlapping_synonyms FROM (SELECT synonym FROM {synonyms} GROUP BY synonym HAVING count(DISTINCT entity_id) > 1) q")(lambda m: lookups.overlap_total(m["synonyms"]))
entry("effect_histogram", "SELECT effect, CAST(count(*) AS BIGINT) AS n, CASE effect WHEN 'activates' THEN 1 WHEN 'inhibits' THEN -1 ELSE 0 END AS sign, true AS mapped FROM {interactions} GROUP BY effect")(lambda m: lookups.effect_histogram(m.interactions))
entry("unmapped_effects", "SELECT event_type AS effect, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, effect LIMIT 10")(lambda m: lookups.unmapped_effects(m["events"].select(F.col("event_type").alias("effect"))))
entry("evidence_star", """SELECT e.id, i.score AS composite_score, i.label, p.year AS paper_year, a.canonical_name AS name_a, b.canonical_name AS name_b FROM {evidence} e JOIN {interactions} i ON i.id = e.interaction_id JOIN {papers} p ON p.id = e.paper_id
 JOIN {entities} a ON a.id = e.entity_a JOIN {entities} b ON b.id = e.entity_b""")(lambda m: lookups.star(m["evidence"], m.interactions, m["papers"], m["entities"]).select("id", "composite_score", "label", "paper_year", "name_a", "name_b"))  # fmt: skip
entry("evidence_by_organism", "SELECT id, organism FROM {evidence} WHERE organism IS NULL OR organism <> 'Danio rerio'")(lambda m: m["evidence"].where(~vocab.non_mammalian(F.col("organism"))).select("id", "organism"))
entry("search_by_json_field", "SELECT event_id, event_type FROM {events} WHERE CAST(json_extract_string(props, '$.k') AS INT) = 42")(lambda m: m["events"].where(F.get_json_object("props", "$.k") == "42").select("event_id", "event_type"))
entry("pending_papers", "SELECT id, priority, created_at FROM {papers} WHERE status = 'O' ORDER BY priority, created_at, id LIMIT 25")(lambda m: m["papers"].where("status = 'O'").select("id", "priority", "created_at").orderBy("priority", "created_at", "id").limit(25))

# --- conflicts ---------------------------------------------------------------------------------

CANDIDATES = """SELECT k.* FROM (SELECT a.id AS interaction_a, b.id AS interaction_b, false AS reversed, a.effect AS ea, b.effect AS eb, a.direction AS da, b.direction AS db FROM {interactions} a JOIN {interactions} b
   ON a.interaction_type = b.interaction_type AND a.entity_a = b.entity_a AND a.entity_b = b.entity_b AND a.id < b.id
 UNION ALL SELECT a.id, b.id, true, a.effect, b.effect, a.direction, b.direction FROM {interactions} a JOIN {interactions} b
   ON a.interaction_type = b.interaction_type AND a.entity_a = b.entity_b AND a.entity_b = b.entity_a AND a.id < b.id WHERE a.entity_a <> a.entity_b) k
 JOIN {psets} pa ON pa.interaction_id = interaction_a JOIN {psets} pb ON pb.interaction_id = interaction_b
 WHERE (ea <> eb OR (da <> 'undirected' AND db <> 'undirected' AND da <> db))
 AND len(list_filter(pa.papers, lambda x: NOT list_contains(pb.papers, x))) > 0 AND len(list_filter(pb.papers, lambda x: NOT list_contains(pa.papers, x))) > 0"""
PSETS = "SELECT interaction_id, list(DISTINCT paper_id) AS papers FROM {evidence} GROUP BY interaction_id"
SETS = """SELECT interaction_id, list(DISTINCT norm_organism) FILTER (WHERE norm_organism IS NOT NULL) AS o, list(DISTINCT norm_tissue) FILTER (WHERE norm_tissue IS NOT NULL) AS t, list(DISTINCT norm_condition) FILTER (WHERE norm_condition IS NOT NULL) AS c FROM {contexts} GROUP BY interaction_id"""
CLASSIFIED = """SELECT concat(interaction_a, '~', interaction_b) AS id, interaction_a, interaction_b, CASE WHEN ea = eb THEN 'direction' ELSE 'effect' END AS conflict_axis, kind AS conflict_type, CASE WHEN kind = 'ambiguous' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS penalty_weight, 'open' AS status FROM (
 SELECT k.*, CASE WHEN len(coalesce(x.o, [])) + len(coalesce(y.o, [])) > 0 AND NOT list_has_any(coalesce(x.o, []), coalesce(y.o, [])) THEN 'context_dependent'
 WHEN (len(coalesce(x.t, [])) + len(coalesce(y.t, [])) > 0 AND (NOT list_has_all(coalesce(x.t, []), coalesce(y.t, [])) OR NOT list_has_all(coalesce(y.t, []), coalesce(x.t, []))) OR len(coalesce(x.c, [])) + len(coalesce(y.c, [])) > 0 AND (NOT list_has_all(coalesce(x.c, []), coalesce(y.c, [])) OR NOT list_has_all(coalesce(y.c, []), coalesce(x.c, []))))
   AND NOT list_has_any(coalesce(x.t, []), coalesce(y.t, [])) AND NOT list_has_any(coalesce(x.c, []), coalesce(y.c, [])) THEN 'context_dependent' ELSE 'ambiguous' END AS kind
 FROM {candidates} k LEFT JOIN {sets} x ON x.interaction_id = interaction_a LEFT JOIN {sets} y ON y.interaction_id = interaction_b) q"""
CF = EV | {"psets": PSETS, "candidates": CANDIDATES, "sets": SETS, "conflicts": CLASSIFIED}


def detected(m: Model) -> DataFrame:
    """The conflicts; all of them are between contested claims."""
    return m.kept("conflicts", lambda: conflicts.detect(m.contested.interactions, confidence.with_contexts(m.contested["evidence"])))


def grounds(m: Model) -> DataFrame:
    """The adjudicated evidence on contested claims, of which conflicts are judged."""
    return m.kept("grounds", lambda: confidence.adjudicate(confidence.with_contexts(m.contested["evidence"])))


#: The conflicts in all states.
STATED = """SELECT id, interaction_a, interaction_b, conflict_axis, conflict_type, penalty_weight, CASE length(id) % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'investigating' WHEN 3 THEN 'reopened' ELSE 'open' END AS status FROM {conflicts}"""


def stated(m: Model) -> DataFrame:
    n = F.length("id") % 6
    return detected(m).withColumn("status", F.when(n == 0, "resolved").when(n == 1, "dismissed").when(n == 2, "investigating").when(n == 3, "reopened").otherwise("open"))


entry("conflict_candidates", "SELECT interaction_a, interaction_b, reversed FROM {candidates}", **CF)(lambda m: conflicts.candidates(m.contested.interactions, m.contested["evidence"]))
FLIPS = """SELECT id, CASE WHEN length(id) % 2 = 0 THEN entity_b ELSE entity_a END AS entity_a, CASE WHEN length(id) % 2 = 0 THEN entity_a ELSE entity_b END AS entity_b, interaction_type, effect, direction FROM {interactions}"""
entry("conflict_candidates_reversed", CANDIDATES.replace("{interactions}", "{flips}").replace("SELECT k.*", "SELECT interaction_a, interaction_b, reversed", 1) + " AND NOT (ea = 'activates' AND eb = 'binds')", **CF, flips=FLIPS)(lambda m: reversed_candidates(m))


def reversed_candidates(m: Model) -> DataFrame:
    """Candidates where half of the interactions name their ends the other way round, without pairs of an activation and then a binding, which are known."""
    odd = F.length("id") % 2 == 0
    turned = m.contested.interactions.select("id", F.when(odd, F.col("entity_b")).otherwise(F.col("entity_a")).alias("entity_a"), F.when(odd, F.col("entity_a")).otherwise(F.col("entity_b")).alias("entity_b"), "interaction_type", "effect", "direction")
    known = conflicts.candidates(turned.where("effect IN ('activates', 'binds')"), m.contested["evidence"])
    effects = turned.select("id", "effect")
    known = known.join(effects.toDF("interaction_a", "ea"), "interaction_a").join(effects.toDF("interaction_b", "eb"), "interaction_b").where("ea = 'activates' AND eb = 'binds'")
    return conflicts.candidates(turned, m.contested["evidence"], known.select(F.col("interaction_b").alias("interaction_a"), F.col("interaction_a").alias("interaction_b")))


entry("conflicts", "SELECT * FROM {conflicts}", **CF)(detected)
entry("conflict_view", """SELECT c.id AS conflict, c.conflict_type, c.penalty_weight, a.effect AS effect_a, b.effect AS effect_b, e1.canonical_name AS a_left, e2.canonical_name AS a_right, e3.canonical_name AS b_left, e4.canonical_name AS b_right
 FROM {stated} c JOIN {interactions} a ON a.id = c.interaction_a JOIN {interactions} b ON b.id = c.interaction_b JOIN {entities} e1 ON e1.id = a.entity_a JOIN {entities} e2 ON e2.id = a.entity_b JOIN {entities} e3 ON e3.id = b.entity_a JOIN {entities} e4 ON e4.id = b.entity_b
 WHERE c.status IN ('open', 'reopened', 'investigating') ORDER BY c.penalty_weight DESC, c.id LIMIT 50""", **CF, stated=STATED)(lambda m: conflicts.view(stated(m), m.contested.interactions, m["entities"]))  # fmt: skip
entry("conflict_hubs", """SELECT c.id, e1.canonical_name AS name_a, e2.canonical_name AS name_b, a.interaction_type AS type_a, b.interaction_type AS type_b, c.conflict_axis, c.penalty_weight FROM {stated} c JOIN {interactions} a ON a.id = c.interaction_a
 JOIN {interactions} b ON b.id = c.interaction_b JOIN {entities} e1 ON e1.id = a.entity_a JOIN {entities} e2 ON e2.id = a.entity_b WHERE c.status IN ('open', 'reopened', 'investigating') ORDER BY c.penalty_weight DESC, c.id LIMIT 10""", **CF, stated=STATED)(lambda m: conflicts.hubs(stated(m), m.contested.interactions, m["entities"], 10))  # fmt: skip
entry("verification_candidates", """SELECT id, interaction_id, confidence_score FROM {evidence} e WHERE (verification_score IS NULL OR verification_score < 0.3) AND interaction_id IN (SELECT interaction_a FROM {stated} WHERE status IN ('open', 'reopened', 'investigating') UNION SELECT interaction_b FROM {stated} WHERE status IN ('open', 'reopened', 'investigating'))
 ORDER BY confidence_score DESC, id LIMIT 25""", **CF, stated=STATED)(lambda m: conflicts.to_verify(m.contested["evidence"], stated(m)))  # fmt: skip
OUTCOMES = """SELECT id, kind AS recommended, 'resolved' AS status, CASE WHEN kind = 'true_conflict' THEN CASE WHEN ma >= mb THEN pa ELSE pb END END AS resolution_paper_id, CASE WHEN kind = 'true_conflict' THEN 1::DOUBLE ELSE 0::DOUBLE END AS penalty_weight FROM (
 SELECT c.id, a.mean_score AS ma, b.mean_score AS mb, a.best_paper_id AS pa, b.best_paper_id AS pb, CASE WHEN len(coalesce(a.contexts, [])) > 0 AND len(coalesce(b.contexts, [])) > 0 AND NOT list_has_any(a.contexts, b.contexts) AND least(a.mean_score, b.mean_score) >= 0.45 THEN 'context_dependent'
 WHEN (list_has_any(coalesce(a.contexts, []), coalesce(b.contexts, [])) OR len(coalesce(a.contexts, [])) = 0 AND len(coalesce(b.contexts, [])) = 0) AND abs(a.mean_score - b.mean_score) >= 0.3 THEN 'true_conflict'
 WHEN c.conflict_type = 'context_dependent' AND len(coalesce(a.contexts, [])) > 0 AND len(coalesce(b.contexts, [])) > 0 AND NOT list_has_any(a.contexts, b.contexts) THEN 'context_dependent' END AS kind
 FROM {conflicts} c JOIN {summary} a ON a.interaction_id = c.interaction_a JOIN {summary} b ON b.interaction_id = c.interaction_b) q WHERE kind IS NOT NULL"""
entry("conflict_outcomes", "SELECT * FROM {outcomes}", **CF, outcomes=OUTCOMES)(lambda m: conflicts.outcomes(detected(m), grounds(m)).drop("note"))
RESOLVED = """SELECT c.id, c.interaction_a, c.interaction_b, coalesce(o.recommended, c.conflict_type) AS conflict_type, coalesce(o.status, c.status) AS status, coalesce(o.penalty_weight, c.penalty_weight) AS penalty_weight, o.resolution_paper_id FROM {conflicts} c LEFT JOIN {outcomes} o ON o.id = c.id"""


def resolved(m: Model) -> DataFrame:
    return conflicts.resolve(detected(m), conflicts.outcomes(detected(m), grounds(m)))


entry("conflicts_resolved", "SELECT * FROM {resolved}", **CF, outcomes=OUTCOMES, resolved=RESOLVED)(lambda m: resolved(m).drop("conflict_axis"))
entry("conflicts_reopened", """SELECT id, CASE WHEN hit AND status = 'resolved' THEN 'reopened' ELSE status END AS status, CASE WHEN hit AND status = 'resolved' THEN NULL ELSE resolution_paper_id END AS resolution_paper_id FROM (SELECT r.*, r.interaction_a IN (SELECT id FROM {interactions} WHERE evidence_count >= 2)
 OR r.interaction_b IN (SELECT id FROM {interactions} WHERE evidence_count >= 2) AS hit FROM {resolved} r) q""", **CF, outcomes=OUTCOMES, resolved=RESOLVED)(lambda m: conflicts.reopen(resolved(m), m.contested.interactions.where("evidence_count >= 2")).select("id", "status", "resolution_paper_id"))  # fmt: skip
entry("conflict_followups", """SELECT id, 'investigating' AS status, concat('conflict_id:', id, ' | "', interaction_a, '" versus "', interaction_b, '" (', conflict_axis, ')') AS query_text, concat('conflict_id:', id) AS origin FROM {conflicts} WHERE conflict_type = 'ambiguous'""", **CF)(
    lambda m: conflicts.followups(detected(m), detected(m).where("conflict_type != 'ambiguous'"))
)
entry("entity_stats", """SELECT entity, CAST(sum(n) AS BIGINT) AS evidence_total, CAST(sum(k) AS BIGINT) AS open_conflicts FROM (SELECT x.entity, (i.evidence_count) AS n, coalesce(c.k, 0) AS k FROM (SELECT DISTINCT entity, id FROM {ends}) x JOIN {interactions} i ON i.id = x.id
 LEFT JOIN (SELECT interaction_a, count(*) AS k FROM {stated} WHERE status IN ('open', 'reopened', 'investigating') GROUP BY interaction_a) c ON c.interaction_a = x.id) q GROUP BY entity""", **CF, **DEG, stated=STATED)(lambda m: lookups.entity_stats(m.stored().interactions, None, stated(m), m.contested.interactions))  # fmt: skip
entry("stats_bundle", """SELECT *, round(entities::DOUBLE * interactions / (1 + conflict_weight), 4) AS score FROM (SELECT CAST((SELECT count(*) FROM {entities}) AS BIGINT) AS entities, CAST((SELECT count(*) FROM {interactions}) AS BIGINT) AS interactions, CAST((SELECT count(*) FROM {evidence}) AS BIGINT) AS evidence,
 CAST((SELECT count(*) FROM {papers}) AS BIGINT) AS papers, CAST((SELECT count(*) FROM {stated} WHERE status IN ('open', 'reopened')) AS BIGINT) AS open_conflicts, CAST((SELECT count(*) FROM {stated} WHERE status = 'resolved') AS BIGINT) AS resolved_conflicts, (SELECT coalesce(sum(penalty_weight), 0) FROM {stated} WHERE status IN ('open', 'reopened', 'investigating')) AS conflict_weight,
 (SELECT arg_max(papers_new, id) FROM {searches}) AS last_score, (SELECT arg_max(completed_at, id) FROM {searches}) AS last_cycle_timestamp) q""", **CF, stated=STATED)(
    lambda m: lookups.stats_bundle(m["entities"], m.stored().interactions, m["evidence"], m["papers"], stated(m), metrics=m["searches"].select(F.col("id").alias("cycle"), F.col("papers_new").alias("score"), F.col("completed_at").alias("timestamp")))
)

# --- graph -------------------------------------------------------------------------------------

ARCS = graph_sql.arcs(0.0)


def all_arcs(m: Model) -> DataFrame:
    return graph.arcs(m.stored().interactions, m["entities"])


entry("arcs", "SELECT source, target, branch, id, effect, sign, score FROM {arcs}", arcs=ARCS)(all_arcs)
for mode in ("suppress", "promote"):
    entry(f"propagate_{mode}", graph_sql.propagate(["s0"], [mode], 3), arcs=ARCS)(lambda m, mode=mode: graph.propagate(all_arcs(m), ["s0"], (mode,), 3))
entry("propagate_batch", graph_sql.propagate(["s0", "s1", "s2", "s3"], ["suppress", "promote"], 2), arcs=ARCS)(lambda m: graph.propagate(all_arcs(m), ["s0", "s1", "s2", "s3"], ("suppress", "promote"), 2))
entry("propagate_excluded", graph_sql.excluded("s0", 2), arcs=ARCS)(lambda m: graph.excluded_arcs(all_arcs(m), "s0", 2))
# The names of the round in which the four above left out low scores.
for mode in ("suppress", "promote"):
    entry(f"propagate_{mode}_all", graph_sql.propagate(["s0"], [mode], 3), arcs=ARCS)(lambda m, mode=mode: graph.propagate(all_arcs(m), ["s0"], (mode,), 3))
entry("propagate_batch_all", graph_sql.propagate(["s0", "s1", "s2", "s3"], ["suppress", "promote"], 2), arcs=ARCS)(lambda m: graph.propagate(all_arcs(m), ["s0", "s1", "s2", "s3"], ("suppress", "promote"), 2))
entry("propagate_excluded_all", graph_sql.excluded("s0", 2), arcs=ARCS)(lambda m: graph.excluded_arcs(all_arcs(m), "s0", 2))
entry("neighbourhood", graph_sql.neighbourhood(["s0"], 3, 200, 0.8))(lambda m: graph.neighbourhood(m.stored().interactions, m["entities"], ["s0"], 3, 200, 0.8))
entry("neighbourhood_typed", graph_sql.neighbourhood(["s0"], 2, 200, 0.5, "gene"))(lambda m: graph.neighbourhood(m.stored().interactions, m["entities"], ["s0"], 2, 200, 0.5, ["gene"]))
entry("paths", graph_sql.paths("s0", "s1", 4, 50, 0.93), arcs=ARCS)(lambda m: graph.paths(all_arcs(m), "s0", "s1", 4, 50, 0.93))
entry("paths_all")(lambda m: graph.paths(all_arcs(m), "s0", "s1", 4, 50))  # SQL that lists all of them is too slow; a test holds it against a search

# --- planning ----------------------------------------------------------------------------------

ORIGINS = "SELECT i.entity_a AS target_id, min(c.id) AS conflict FROM {conflicts} c JOIN {interactions} i ON i.id = c.interaction_a GROUP BY i.entity_a"


def with_origins(m: Model) -> DataFrame:
    """Searches; those for a conflict name the first conflict of their target as their origin."""
    first = detected(m).join(m.contested.interactions.select(F.col("id").alias("interaction_a"), "entity_a"), "interaction_a").groupBy(F.col("entity_a").alias("target_id")).agg(F.min("id").alias("conflict"))
    origin = F.when(F.col("query_type") == "conflict_resolution", F.concat(F.lit("conflict_id:"), "conflict")).otherwise("manual")
    return m["searches"].join(first, "target_id", "left").withColumn("origin", origin).drop("conflict")


YIELDS = """SELECT query_type, target_kind, generation_reason, CAST(count(*) AS BIGINT) AS n, avg(new_evidence) AS avg_new_evidence, avg(new_interactions) AS avg_new_interactions, avg(papers_new) AS avg_papers_new, avg(improved) AS avg_improved,
 round(avg(new_evidence) * 0.45::DOUBLE + avg(new_interactions) * 0.85::DOUBLE + avg(papers_new) * 0.15::DOUBLE + avg(improved) * 1.5::DOUBLE, 4) AS yield_score
 FROM (SELECT *, row_number() OVER (PARTITION BY query_type, target_kind, generation_reason ORDER BY completed_at DESC, id DESC) AS place FROM {searches} WHERE status = 'done') q WHERE place <= 50 GROUP BY query_type, target_kind, generation_reason"""
BROAD = """SELECT query_type, generation_reason, count(*) AS n, round(avg(new_evidence) * 0.45::DOUBLE + avg(new_interactions) * 0.85::DOUBLE + avg(papers_new) * 0.15::DOUBLE + avg(improved) * 1.5::DOUBLE, 4) AS yield_score
 FROM (SELECT *, row_number() OVER (PARTITION BY query_type, generation_reason ORDER BY completed_at DESC, id DESC) AS place FROM {searches} WHERE status = 'done') q WHERE place <= 50 GROUP BY query_type, generation_reason"""
entry("yield_stats", "SELECT * FROM {yields}", yields=YIELDS)(lambda m: planner.yields(m["searches"], ["query_type", "target_kind", "generation_reason"]))
entry("planning_scores", """SELECT id, round(gain + less + new_evidence + new_interactions * 1.5::DOUBLE + papers_new * 0.5::DOUBLE + ly - noise - CASE WHEN ly < 0.5 THEN 0.3::DOUBLE ELSE 0 END, 4) AS planning_score, ly AS learned_yield FROM (
 SELECT p.*, coalesce(CASE WHEN p.target_kind IS NULL THEN b.yield_score ELSE y.yield_score END, 0) AS ly, CASE WHEN p.query_type = 'conflict_resolution' THEN 1.0::DOUBLE WHEN p.target_kind = 'entity' THEN 1.8::DOUBLE + coalesce(least(e.paper_count, 10) / 10::DOUBLE, 0) WHEN p.target_kind = 'interaction' THEN 2.2::DOUBLE ELSE 1.2::DOUBLE END AS gain,
 CASE WHEN p.query_type = 'conflict_resolution' THEN 2.0::DOUBLE + coalesce(c.penalty_weight, 0) ELSE 0::DOUBLE END AS less, CASE WHEN p.query_type = 'conflict_resolution' THEN 0::DOUBLE WHEN p.target_kind = 'entity' THEN 0.4::DOUBLE WHEN p.target_kind = 'interaction' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS noise
 FROM {searches} p LEFT JOIN {yields} y ON y.query_type = p.query_type AND y.target_kind = p.target_kind AND y.generation_reason = p.generation_reason AND y.n >= 2 LEFT JOIN {broad} b ON b.query_type = p.query_type AND b.generation_reason = p.generation_reason AND b.n >= 2
 LEFT JOIN {entities} e ON e.id = p.target_id LEFT JOIN {origins} g ON g.target_id = p.target_id LEFT JOIN {conflicts} c ON c.id = g.conflict WHERE p.status = 'pending') q""", yields=YIELDS, broad=BROAD, origins=ORIGINS, **CF)(
    lambda m: planner.score_pending(with_origins(m).where("status = 'pending'"), m["searches"], m["entities"], detected(m))
)
entry("targeted_queries", """SELECT * FROM (SELECT concat('conflict_id:', c.id) AS origin, 'unresolved_conflict_hub' AS reason, concat('"', e1.canonical_name, '"[Title/Abstract] AND "', e2.canonical_name, '"[Title/Abstract] AND (', a.interaction_type, ' OR mechanism OR context OR condition)') AS query_text, round(3.0::DOUBLE + c.penalty_weight, 4) AS planning_score
 FROM {stated} c JOIN {interactions} a ON a.id = c.interaction_a JOIN {entities} e1 ON e1.id = a.entity_a JOIN {entities} e2 ON e2.id = a.entity_b WHERE c.status IN ('open', 'reopened', 'investigating') ORDER BY c.penalty_weight DESC, c.id LIMIT 4) q1
 UNION ALL SELECT * FROM (SELECT concat('entity_id:', e.id), 'sparse_high_value_entity', concat('"', e.canonical_name, '"[Title/Abstract] AND (interaction OR signaling OR regulation OR binding)'), round(2.0::DOUBLE + least(e.paper_count, 10) / 10::DOUBLE - coalesce(d.degree, 0) * 0.25::DOUBLE, 4)
 FROM {entities} e LEFT JOIN {degrees} d ON d.entity = e.id WHERE coalesce(d.degree, 0) < 3 ORDER BY e.paper_count DESC, coalesce(d.degree, 0), e.id LIMIT 4) q2
 UNION ALL SELECT * FROM (SELECT concat('interaction_id:', i.id), 'under_supported_seeded_interaction', concat('"', e1.canonical_name, '"[Title/Abstract] AND "', e2.canonical_name, '"[Title/Abstract] AND (', i.interaction_type, ' OR interaction OR mechanism)'), round(2.6::DOUBLE + greatest(0, 1 - i.evidence_count), 4)
 FROM (SELECT * FROM {interactions} WHERE evidence_count <= 1 AND id IN (SELECT interaction_id FROM {evidence} WHERE evidence_type = 'curated_db') ORDER BY score DESC, evidence_count, id LIMIT 4) i JOIN {entities} e1 ON e1.id = i.entity_a JOIN {entities} e2 ON e2.id = i.entity_b) q3""", **CF, **DEG, stated=STATED)(
    lambda m: planner.targeted(stated(m), m.stored().interactions, m["entities"], {"conflict": 4, "entity": 4, "interaction": 4}, sides=m.contested.interactions, curated=m.stored().every.where("curated > 0"))
)


def papers_of_queries(m: Model) -> DataFrame:
    keys = F.array_distinct(F.array(F.concat(F.lit("q"), (F.col("source_key") % 7).cast("string")), F.concat(F.lit("q"), (F.col("source_key") % 5).cast("string"))))
    return m["papers"].select("id", keys.alias("query_ids"), F.col("priority").alias("title"), F.col("year").alias("priority"), F.col("created_at").alias("arrival"), "source_key")


entry("outcome_attribution", """SELECT q AS query_id, round(sum(n_interactions / k), 6) AS attributed_interactions, round(sum(n_evidence / k), 6) AS attributed_evidence, CAST(count(*) AS BIGINT) AS papers FROM (SELECT id, unnest(qs) AS q, CAST(len(qs) AS DOUBLE) AS k FROM (SELECT id, list_distinct([concat('q', CAST(source_key % 7 AS VARCHAR)), concat('q', CAST(source_key % 5 AS VARCHAR))]) AS qs FROM {papers}) a) b
 JOIN (SELECT paper_id, count(DISTINCT interaction_id) AS n_interactions, count(*) AS n_evidence FROM {evidence} GROUP BY paper_id) o ON o.paper_id = b.id GROUP BY q""")(
    lambda m: planner.attribute(papers_of_queries(m), m["evidence"].groupBy("paper_id").agg(F.count_distinct("interaction_id").alias("n_interactions"), F.count("*").alias("n_evidence")))
)
entry("paper_merge", """SELECT id, array_to_string(list_sort(list_distinct(flatten(list(qs)))), ',') AS query_ids, max(year) AS priority, arg_min(priority, created_at) AS title FROM (SELECT concat('c', CAST(source_key AS VARCHAR)) AS id, [concat('q', CAST(source_key % 7 AS VARCHAR)), concat('q', CAST(source_key % 5 AS VARCHAR))] AS qs, year,
 priority, concat(CAST(created_at AS VARCHAR), id) AS created_at FROM {papers}) q GROUP BY id""")(
    lambda m: planner.merge_papers(papers_of_queries(m).withColumn("arrival", F.concat(F.date_format("arrival", "yyyy-MM-dd HH:mm:ss"), "id")).withColumn("id", F.concat(F.lit("c"), "source_key"))).withColumn("query_ids", F.array_join("query_ids", ","))
)
entry("query_insert_if_absent", """SELECT DISTINCT query_type, target_id, papers_new FROM {searches} WHERE status = 'pending' AND (query_type, target_id, papers_new) NOT IN (SELECT query_type, target_id, papers_new FROM {searches} WHERE status IN ('running', 'done'))""")(
    lambda m: resolve.insert_if_absent(m["searches"].where("status IN ('running', 'done')"), m["searches"].where("status = 'pending'").select("query_type", "target_id", "papers_new"), ["query_type", "target_id", "papers_new"])
)
entry("cycle_scores", "SELECT day, searches, CAST(searches - lag(searches) OVER (ORDER BY day) AS BIGINT) AS gained FROM (SELECT date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS searches FROM {events} GROUP BY 1) q")(
    lambda m: history.gains(m["events"])
)
entry("outcomes_by_day", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, CAST(count(*) AS BIGINT) AS searches, round(sum(value), 4) AS total_value FROM {events} GROUP BY 1, 2")(lambda m: ingest.outcome_stream(m["events"]))

# --- entity resolution -------------------------------------------------------------------------


def mentions(m: Model) -> DataFrame:
    """Names as a text gives them: of parts, suppliers and shared labels, with stray blanks and case; the labels' with organisms, some without types."""
    none = F.lit(None).cast("string")
    parts = m["part"].select(F.concat(F.lit("m"), "p_partkey").alias("mention"), F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.when(F.col("p_size") % 3 == 0, "protein").otherwise("metabolite").alias("entity_type"), none.alias("organism"))
    brands = m["part"].select(F.concat(F.lit("b"), "p_partkey"), F.concat("p_brand", F.lit(" "), "p_name"), F.lit("gene"), none)
    firms = m["supplier"].select(F.concat(F.lit("f"), "s_suppkey"), "s_name", F.lit("gene"), none)
    kind = F.when(F.col("c_custkey") % 3 == 0, "pathway").when(F.col("c_custkey") % 3 == 1, "protein")
    labels = m["customer"].join(m["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "c_custkey"), F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey") % 40), kind, F.when(F.col("c_custkey") % 5 > 0, F.lower("n_name")))
    return parts.unionAll(brands).unionAll(firms).unionAll(labels)


def shared_names(m: Model) -> DataFrame:
    """The synonyms, and labels that entities of several types and organisms share."""
    labels = m["customer"].select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_custkey") % 40))
    firms = m["supplier"].select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("building "), F.col("s_suppkey") % 40))
    return m["synonyms"].unionAll(labels).unionAll(firms)


MENTIONS = """SELECT concat('m', CAST(p_partkey AS STRING)) AS mention, concat(' ', upper(p_name)) AS name, CASE WHEN p_size % 3 = 0 THEN 'protein' ELSE 'metabolite' END AS entity_type, NULL AS organism FROM {part}
 UNION ALL SELECT concat('b', CAST(p_partkey AS STRING)), concat(p_brand, ' ', p_name), 'gene', NULL FROM {part} UNION ALL SELECT concat('f', CAST(s_suppkey AS STRING)), s_name, 'gene', NULL FROM {supplier}
 UNION ALL SELECT concat('n', CAST(c_custkey AS STRING)), concat(c_mktsegment, ' ', c_custkey % 40), CASE c_custkey % 3 WHEN 0 THEN 'pathway' WHEN 1 THEN 'protein' END, CASE WHEN c_custkey % 5 > 0 THEN lower(n_name) END FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"""
SHARED = """SELECT entity_id, synonym FROM {synonyms} UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat(lower(c_mktsegment), ' ', c_custkey % 40) FROM {customer} UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('building ', s_suppkey % 40) FROM {supplier}"""


def exact_sql(rungs: dict[str, str]) -> str:
    """Each rung as a condition on candidates: the first one that leaves a single entity decides."""
    counts = ", ".join(f"count(DISTINCT id) FILTER (WHERE {rule}) AS n{i}, min(id) FILTER (WHERE {rule}) AS i{i}" for i, rule in enumerate(rungs.values()))
    case = lambda value: "CASE " + " ".join(f"WHEN n{i} = 1 THEN {value(i, name)}" for i, name in enumerate(rungs)) + " END"
    return f"""SELECT * FROM (SELECT mention, {case(lambda i, _: f"i{i}")} AS entity_id, {case(lambda _, name: f"'{name}'")} AS rung FROM (SELECT mention, {counts}
 FROM (SELECT m.mention, m.entity_type AS mt, lower(m.organism) AS mo, e.id, e.entity_type AS t, lower(e.organism) AS o, lower(trim(e.canonical_name)) AS c, lower(trim(m.name)) AS k, CASE WHEN m.entity_type IN ('gene', 'protein') THEN 'gp' ELSE m.entity_type END AS mg, CASE WHEN e.entity_type IN ('gene', 'protein') THEN 'gp' ELSE e.entity_type END AS g
  FROM {{mentions}} m JOIN {{shared}} s ON s.synonym = lower(trim(m.name)) JOIN {{entities}} e ON e.id = s.entity_id) q GROUP BY mention) r) x WHERE entity_id IS NOT NULL"""


EXACT = exact_sql({"unique": "true", "type_organism": "t = mt AND o = mo", "organism": "o = mo", "type": "t = mt", "group": "g = mg", "canonical": "c = k"})
STORE_EXACT = exact_sql({"unique": "true", "type": "t = mt", "type_organism": "t = mt AND o = mo", "untyped_organism": "mt IS NULL AND o = mo"})
entry("resolve_exact", "SELECT * FROM {exact}", mentions=MENTIONS, exact=EXACT, shared=SHARED)(lambda m: resolve.exact(mentions(m), m["entities"], shared_names(m)))
entry("resolve_cascade")(lambda m: resolve.cascade(mentions(m), m["entities"], m["synonyms"]))
entry("resolve_fuzzy")(lambda m: resolve.fuzzy(m["customer"].select(F.concat(F.lit("x"), "c_custkey").alias("mention"), F.concat("c_name", F.lit("s")).alias("name"), F.lit("pathway").alias("entity_type")), m["entities"]))
entry("synonyms_learned", "SELECT DISTINCT x.entity_id, concat(lower(trim(m.name)), ' (syn)') AS synonym FROM {mentions} m JOIN {exact} x ON x.mention = m.mention EXCEPT SELECT entity_id, synonym FROM {synonyms}", mentions=MENTIONS, exact=EXACT, shared=SHARED)(
    lambda m: resolve.learn_synonyms(resolve.exact(mentions(m), m["entities"], shared_names(m)), mentions(m).withColumn("name", F.concat("name", F.lit(" (Syn)"))), m["synonyms"])
)
entry("entity_upsert", """SELECT canonical_name, organism, min(id) AS id FROM {entities} WHERE organism IS NOT NULL GROUP BY canonical_name, organism UNION ALL SELECT canonical_name, organism, id FROM {entities} WHERE organism IS NULL
 UNION ALL SELECT canonical_name, organism, id FROM {entities} WHERE organism IS NULL AND entity_type = 'gene'""")(
    lambda m: resolve.upsert(m["entities"].select("canonical_name", "organism", "id").where("entity_type = 'gene'"), m["entities"].select("canonical_name", "organism", "id"), ["canonical_name", "organism"], F.col("id"))
)
entry("cache_merge", """SELECT entity, mode, CAST(CASE WHEN d0 > coalesce(d1, -1) THEN d0 ELSE d1 END AS INT) AS max_depth, CASE WHEN d0 > coalesce(d1, -1) THEN 'old' ELSE 'new' END AS result, coalesce(e1, e0) AS expires, CAST(CASE WHEN d1 IS NOT NULL THEN 0 ELSE 7 END AS INT) AS hits FROM (
 SELECT concat('s', CAST(user_id AS VARCHAR)) AS entity, event_type AS mode, max(event_id % 5) FILTER (WHERE value <= 50) AS d0, max(event_id % 5) FILTER (WHERE value > 50) AS d1, max(ts) FILTER (WHERE value <= 50) AS e0, max(ts) FILTER (WHERE value > 50) AS e1 FROM {events} GROUP BY 1, 2) q""")(
    lambda m: resolve.merge_cache(*[
        m["events"].where(keep).groupBy(F.concat(F.lit("s"), "user_id").alias("entity"), F.col("event_type").alias("mode")).agg(F.max(F.col("event_id") % 5).cast("int").alias("max_depth"), F.lit(name).alias("result"), F.max("ts").alias("expires"), F.lit(hits).alias("hits"))
        for keep, name, hits in (("value <= 50", "old", 7), ("value > 50", "new", 0))
    ])
)

# --- text --------------------------------------------------------------------------------------

entry("enum_normalise", """SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE event_type END AS entity_type, CAST(greatest(0, least(1, value)) AS DOUBLE) AS confidence FROM {events}""")(
    lambda m: m["events"].select("event_id", vocab.enum(F.upper("event_type"), vocab.ENTITY_ALIASES).alias("entity_type"), vocab.clamp(F.col("value").cast("string")).alias("confidence"))
)
entry("interaction_enum", """SELECT effect, interaction_type, CASE effect WHEN 'binds' THEN 'binds' ELSE 'unknown' END AS kind, interaction_type AS kept, CAST(count(*) AS BIGINT) AS n FROM {claims} GROUP BY effect, interaction_type""")(
    lambda m: m["claims"].select("effect", "interaction_type", vocab.enum(F.concat(F.lit(" "), F.upper("effect")), vocab.INTERACTION_ALIASES).alias("kind"), vocab.enum(F.replace("interaction_type", F.lit("_"), F.lit("-")), vocab.INTERACTION_ALIASES).alias("kept")).groupBy("effect", "interaction_type", "kind", "kept").agg(F.count("*").alias("n"))
)
entry("whitespace", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '')) AS digest FROM {documents}""")(
    lambda m: m["documents"].select("doc_id", F.sha2(text.whitespace(F.col("text")), 256).alias("digest"))
)
entry("markup_stripped", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '')) AS digest FROM {pages}""")(lambda m: m["pages"].select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("digest")))
entry("snippet_offsets", "SELECT doc_id, CAST(CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 1 END AS INT) AS start, CAST(CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') + 3 END AS INT) AS stop FROM {documents}")(
    lambda m: m["documents"].select("doc_id", text.offsets(F.lit("The "), F.col("text")).alias("at")).select("doc_id", "at.start", F.col("at.end").alias("stop"))
)
entry("chunks")(lambda m: text.chunk(m["documents"]).select("doc_id", "chunk", "start", "stop", F.sha2("text", 256).alias("digest")))
entry("snippets_supported")(lambda m: text.snippets_supported(m["documents"].select("doc_id", F.substring("text", 11, 60).alias("snippet"), F.reverse("text").alias("text"))).select("doc_id", "found"))
VERIFY = """SELECT id, CASE WHEN k > 0 THEN 'needs_review' ELSE 'verified' END AS check_status, round(CASE WHEN k > 0 THEN greatest(0.2::DOUBLE, 1 - 0.2::DOUBLE * k) ELSE 0.8::DOUBLE END, 4) AS check_score FROM (
 SELECT id, 1 + CASE WHEN organism IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN tissue_cell_type IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN condition IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN direction IN ('A_to_B', 'B_to_A') THEN CASE WHEN strpos(lower(coalesce(snippet, '')), lower(entity_a)) > 0 AND strpos(lower(coalesce(snippet, '')), lower(entity_b)) > 0 THEN 0 ELSE 1 END ELSE 0 END AS k FROM {evidence}) q"""
entry("heuristic_verify", VERIFY)(
    lambda m: text.verify(m["evidence"].select("id", "effect", "organism", F.col("tissue_cell_type").alias("tissue"), "condition", "direction", F.col("entity_a").alias("name_a"), F.col("entity_b").alias("name_b"), "snippet", F.lit(None).cast("string").alias("source"))).select("id", "check_status", "check_score")
)
entry("model_output", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}")(
    lambda m: text.parse_output(m["events"].select("event_id", F.concat(F.lit("<think>{no}</think> call: "), F.expr("substring(props, 1, length(props) - 1)")).alias("said")), "said").select("event_id", F.get_json_object("parsed", "$.k").cast("int").alias("k"))
)

# --- sources and sinks -------------------------------------------------------------------------


def mitab_lines(m: Model) -> DataFrame:
    """Claims written as lines of the 14-column format."""
    term = F.when(F.col("effect") == "binds", F.lit('psi-mi:"MI:0407"(direct interaction)')).when(F.col("effect") == "inhibits", F.lit('psi-mi:"MI:0217"(phosphorylation)')).otherwise("psi-mi:unknown")
    cells = [F.concat(F.lit("uniprotkb:"), F.upper("entity_a"), F.lit("-2")), F.concat(F.lit("uniprotkb:"), F.upper("entity_b")), *[F.lit("-")] * 6, F.concat(F.lit("pubmed:"), "paper_id"), F.lit("-"), F.lit("-"), term, F.lit("-"), F.concat(F.lit("reactome:"), "interaction_type")]
    return m["claims"].select(F.concat_ws("\t", *cells).alias("line"))


entry("source_mitab", """SELECT upper(entity_a) AS acc_a, upper(entity_b) AS acc_b, CASE effect WHEN 'binds' THEN 'MI:0407' WHEN 'inhibits' THEN 'MI:0217' ELSE '' END AS mi_term, interaction_type AS pathway_id, paper_id AS publications,
 CASE effect WHEN 'binds' THEN 'direct_binding' WHEN 'inhibits' THEN 'post_translational' ELSE 'unknown' END AS interaction_type, CASE effect WHEN 'inhibits' THEN 'phosphorylates' ELSE 'binds' END AS effect, CASE effect WHEN 'inhibits' THEN 'A_to_B' ELSE 'undirected' END AS direction FROM {claims}""")(lambda m: tabular.psi_mitab(mitab_lines(m)))  # fmt: skip


def signed_lines(m: Model) -> DataFrame:
    """Claims written as lines of the 28-column format: known and unknown mechanisms, with every sense and none."""
    cells = [F.lit("-")] * 28
    sense = F.when(F.col("line_no") == 7, "unknown").when(F.col("effect") == "activates", "up-regulates activity").when(F.col("effect") == "inhibits", "down-regulates").otherwise("form complex")
    mechanism = F.when(F.col("line_no").isin(4, 7), "mystery").when(F.col("interaction_type") == "direct_binding", "binding").when(F.col("interaction_type") == "transcriptional", "transcriptional regulation").otherwise("phosphorylation")
    put = {1: F.lit("protein"), 2: F.concat("entity_a", F.lit("-PRO_1")), 3: F.lit("UNIPROT"), 5: F.lit("protein"), 6: F.col("entity_b"), 7: F.lit("UNIPROT"), 8: sense, 9: mechanism, 13: F.lit(""), 14: F.lit("liver"), 21: F.col("paper_id"), 26: F.concat(F.lit("r"), "paper_id"), 27: F.when(F.col("line_no") == 1, F.lit("n/a")).otherwise(F.col("confidence_score").cast("string"))}
    return m["claims"].select(F.concat_ws("\t", *[put.get(i, c) for i, c in enumerate(cells)]).alias("line"))


#: Written from the rule: unknown mechanisms (lines 4 and 7) by their sense, generic ones refined by it, the others as the list has them.
SIGNED = """SELECT *, CASE WHEN interaction_type = 'direct_binding' THEN 'undirected' ELSE 'A_to_B' END AS direction, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS label, 'liver' AS context FROM (
 SELECT upper(entity_a) AS acc_a, upper(entity_b) AS acc_b, paper_id AS publication, concat('r', paper_id) AS record, CASE WHEN line_no IN (4, 7) THEN 'mystery' WHEN interaction_type = 'direct_binding' THEN 'binding' WHEN interaction_type = 'transcriptional' THEN 'transcriptional regulation' ELSE 'phosphorylation' END AS mechanism,
 CASE WHEN line_no = 7 THEN 'unknown' WHEN effect = 'activates' THEN 'up-regulates activity' WHEN effect = 'inhibits' THEN 'down-regulates' ELSE 'form complex' END AS raw_effect, CASE WHEN line_no = 1 THEN 0.7::DOUBLE ELSE confidence_score END AS score,
 CASE WHEN line_no = 7 THEN 'unknown' WHEN line_no = 4 THEN CASE WHEN effect = 'binds' THEN 'direct_binding' ELSE 'signaling' END WHEN interaction_type = 'transcriptional' AND effect = 'binds' THEN 'direct_binding' ELSE interaction_type END AS interaction_type,
 CASE WHEN line_no = 7 THEN 'binds' WHEN line_no = 4 THEN effect WHEN interaction_type = 'post_translational' THEN 'phosphorylates' ELSE effect END AS effect FROM {claims}) q"""
entry("source_signed", "SELECT * FROM {signed}", signed=SIGNED)(lambda m: tabular.signed_records(signed_lines(m)))


def entry_json(m: Model) -> DataFrame:
    """Claims written as JSON entries of their first end; a single experiment isn't written, nor whether organisms differ where they don't."""
    two = F.struct(F.upper("entity_b").alias("uniProtKBAccession"), F.concat(F.lit("EBI-"), "entity_b").alias("intActId"))
    one = F.struct(F.when(F.col("line_no") != 3, F.concat(F.lit("EBI-"), "entity_a")).alias("intActId"))
    inter = F.struct(one.alias("interactantOne"), two.alias("interactantTwo"), F.when(F.col("line_no") > 1, F.col("line_no")).cast("int").alias("numberOfExperiments"), F.when(F.col("line_no") == 7, True).alias("organismDiffer"))
    comments = F.array(F.struct(F.lit("INTERACTION").alias("commentType"), F.array(inter).alias("interactions")))
    return m["claims"].select(F.to_json(F.struct(F.upper("entity_a").alias("primaryAccession"), comments.alias("comments"))).alias("entry"))


ENTRIES_SQL = """SELECT acc_a, acc_b, CAST(n AS INT) AS experiments, record, CASE WHEN n >= 5 THEN 0.9::DOUBLE WHEN n >= 3 THEN 0.8::DOUBLE WHEN n >= 2 THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS score, CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END AS label FROM (
 SELECT least(upper(entity_a), upper(entity_b)) AS acc_a, greatest(upper(entity_a), upper(entity_b)) AS acc_b, max(line_no) AS n, CASE WHEN max(line_no) = 3 THEN concat('noid-', upper(min(entity_a))) ELSE concat('EBI-', min(entity_a)) END AS record FROM {claims} WHERE line_no <> 7 GROUP BY 1, 2) q"""
entry("source_entries", "SELECT * FROM {entries}", entries=ENTRIES_SQL)(lambda m: tabular.entry_interactions(entry_json(m)))


def article_xml(m: Model) -> DataFrame:
    """Papers written as XML records: markup inside texts, labelled sections, an author without a first name and one without a last name."""
    record = F.format_string(
        '<A><PMID>%s</PMID><Article><ArticleTitle>On <i>%s</i> ways</ArticleTitle><Abstract><AbstractText>%s <b>x</b>y</AbstractText><AbstractText Label="AIM">z</AbstractText><AbstractText/></Abstract>'
        "<AuthorList><Author><LastName>Roe</LastName></Author><Author><ForeName>Al</ForeName></Author><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author></AuthorList><Journal><ISOAbbreviation>J</ISOAbbreviation></Journal>"
        '<PubDate><Year>%s</Year></PubDate></Article>%s</A>', "id", "priority", "status", F.col("year").cast("string"), F.when(F.col("source_key") % 2 == 0, F.format_string('<ArticleId IdType="pmc">PMC%s</ArticleId>', F.col("source_key").cast("string"))).otherwise(""),
    )
    return m["papers"].select(record.alias("record"))


entry("source_articles", """SELECT concat('pmid:', id) AS id, concat('On ', priority, ' ways') AS title, concat(status, ' xy', chr(10), chr(10), 'AIM: z') AS abstract, 'Roe;Doe, J' AS authors, year, 'J' AS journal, CAST(NULL AS VARCHAR) AS doi, CASE WHEN source_key % 2 = 0 THEN CAST(source_key AS VARCHAR) END AS pmc_id,
 source_key % 2 = 0 AS full_text_available FROM {papers}""")(lambda m: tabular.articles(article_xml(m)).withColumn("authors", F.array_join("authors", ";")))  # fmt: skip
entry("graph_export", """SELECT i.id, i.label, i.evidence_count, x.n_evidence, x.first_paper FROM {interactions} i JOIN (SELECT interaction_id, CAST(count(*) AS BIGINT) AS n_evidence, arg_min(paper_id, id) AS first_paper FROM {evidence} GROUP BY interaction_id) x ON x.interaction_id = i.id WHERE label <> 'low' AND evidence_count >= 1""")(
    lambda m: sinks.export_edges(m.interactions, m["evidence"], "medium").select("id", "label", "evidence_count", F.size("evidence").cast("long").alias("n_evidence"), F.col("evidence")[0]["paper_id"].alias("first_paper"))
)
entry("graphml", """SELECT 1 AS part, id, concat('<node id="', id, '"><data key="name">', canonical_name, '</data><data key="type">', entity_type, '</data></node>') AS line FROM {entities}
 UNION ALL SELECT 2, id, concat('<edge source="', entity_a, '" target="', entity_b, '"><data key="effect">', effect, '</data><data key="confidence">', label, '</data></edge>') FROM {interactions}""")(lambda m: sinks.graphml(m["entities"], m.interactions))  # fmt: skip

from claimweave.plans import more  # noqa: E402,F401  registers the rest, with the tables above
