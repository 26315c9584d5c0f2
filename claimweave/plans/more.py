"""Registered queries of loads, writes, reprocessing, model output, entries, names and small reads; their SQL is written from the rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import output, text
from claimweave.operators import confidence, conflicts, graph, history, loads, lookups, reprocess, resolve, warming, writes
from claimweave.plans import graph_sql
from claimweave.plans.catalog import ARCS, CF, DEG, EV, EXACT, OUTCOMES, RESOLVED, SHARED, SIGNED, STORE_EXACT, ENTRIES_SQL, STATED, VERIFY, adjudicated, detected, entry, entry_json, grounds, mentions, MENTIONS, mitab_lines, resolved, shared_names, signed_lines, stated, all_arcs
from claimweave.plans.projection import Model
from claimweave.session import shared_dir
from claimweave.sources import entries, tabular
from claimweave.streaming import cycle

# --- curated loads -----------------------------------------------------------------------------

ACC = "SELECT upper(id) AS acc, id AS entity_id FROM {entities} WHERE paper_count >= 5"
MITAB = """SELECT upper(entity_a) AS acc_a, upper(entity_b) AS acc_b, interaction_type AS pathway_id, CASE effect WHEN 'binds' THEN 'direct interaction' WHEN 'inhibits' THEN 'phosphorylation' ELSE '' END AS mi_label,
 CASE effect WHEN 'binds' THEN 'direct_binding' WHEN 'inhibits' THEN 'post_translational' ELSE 'unknown' END AS interaction_type, CASE effect WHEN 'inhibits' THEN 'phosphorylates' ELSE 'binds' END AS effect, CASE effect WHEN 'inhibits' THEN 'A_to_B' ELSE 'undirected' END AS direction FROM {claims}"""
RECORDS = """SELECT acc_a, acc_b, interaction_type, effect, direction, concat('reactome:', pathway_id) AS paper_id, 'reactome' AS source, concat('Reactome pathway ', pathway_id) AS title, 0.75::DOUBLE AS score, 'high' AS label, concat('Reactome pathway ', pathway_id, ': ', acc_a, ' ', mi_label, ' ', acc_b) AS snippet, NULL AS tissue FROM {mitab}
 UNION ALL SELECT acc_a, acc_b, interaction_type, effect, direction, concat('signor:', record), 'signor', concat('SIGNOR curated interaction ', record, ': ', acc_a, ' ', mechanism, ' ', acc_b), score, label, concat('SIGNOR ', record, ': ', acc_a, ' ', raw_effect, ' ', acc_b, ' via ', mechanism), context FROM {signed}
 UNION ALL SELECT acc_a, acc_b, 'direct_binding', 'binds', 'undirected', concat('uniprot:', record), 'uniprot', concat('IntAct curated interaction: ', acc_a, ' / ', acc_b), score, label, concat('IntAct binary interaction: ', acc_a, ' / ', acc_b, ' (', CAST(experiments AS VARCHAR), ' experiment(s))'), NULL FROM {entries}"""
PLACED = "SELECT r.*, a.entity_id AS entity_a, b.entity_id AS entity_b, concat_ws('|', a.entity_id, b.entity_id, interaction_type, effect, direction) AS interaction_id FROM {records} r JOIN {acc} a ON a.acc = r.acc_a JOIN {acc} b ON b.acc = r.acc_b"
LOADS = {"acc": ACC, "mitab": MITAB, "signed": SIGNED, "entries": ENTRIES_SQL, "records": RECORDS, "placed": PLACED}


def placed(m: Model, *sources: str) -> DataFrame:
    """Records of the three kinds of files, with their entities; only entities of five papers or more are known by accession."""
    ids = m["entities"].where("paper_count >= 5").select(F.upper("id").alias("accession"), F.col("id").alias("entity_id"))
    read = {
        "reactome": lambda: loads.psi_mitab_records(tabular.psi_mitab(mitab_lines(m), with_label=True)),
        "signor": lambda: loads.signed_file_records(tabular.signed_records(signed_lines(m))),
        "uniprot": lambda: loads.entry_records(tabular.entry_interactions(entry_json(m))),
    }
    rows = None
    for s in sources:
        rows = read[s]() if rows is None else rows.unionByName(read[s]())
    return loads.placed(rows, ids)


for source in ("uniprot", "reactome", "signor"):
    entry(f"curated_load_{source}", f"""SELECT interaction_id, paper_id, score AS confidence_score, label AS confidence, snippet, tissue AS tissue_cell_type FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id, paper_id ORDER BY score DESC, snippet) AS r FROM {{placed}} WHERE source = '{source}') q
     WHERE r = 1 AND (interaction_id, paper_id) NOT IN (SELECT interaction_id, concat('signor:r', paper_id) FROM {{evidence}} WHERE year < 1994)""", **LOADS)(
        lambda m, source=source: loads.new_evidence(placed(m, source), m["evidence"].where("year < 1994").select("interaction_id", F.concat(F.lit("signor:r"), "paper_id").alias("paper_id"))).select("interaction_id", "paper_id", "confidence_score", "confidence", "snippet", "tissue_cell_type")
    )
entry("curated_papers", "SELECT paper_id AS id, min(source) AS source, min(title) AS title, 'abstract_only' AS fetch_status, 'done' AS extraction_status FROM {placed} WHERE paper_id NOT IN (SELECT concat('signor:r', id) FROM {papers} WHERE status = 'F') GROUP BY paper_id", **LOADS)(
    lambda m: loads.new_papers(placed(m, "uniprot", "reactome", "signor"), m["papers"].where("status = 'F'").select(F.concat(F.lit("signor:r"), "id").alias("id"))).drop("abstract")
)
entry("curated_interactions", "SELECT DISTINCT interaction_id, entity_a, entity_b, interaction_type, effect, direction FROM {placed} WHERE interaction_id NOT IN (SELECT id FROM {interactions} WHERE evidence_count > 1)", **LOADS)(
    lambda m: loads.new_interactions(placed(m, "uniprot", "reactome", "signor"), m.stored().interactions.where("evidence_count > 1"))
)
entry("accession_get_or_create", """SELECT accession, coalesce(c, s, x, n) AS entity_id, CASE WHEN c IS NOT NULL THEN 'cache' WHEN s IS NOT NULL THEN 'synonym' WHEN x IS NOT NULL THEN 'external' WHEN n IS NOT NULL THEN 'created' END AS how FROM (
 SELECT upper(s_name) || '-2' AS accession, CASE WHEN s_suppkey % 5 = 0 THEN concat('s', CAST(s_suppkey AS VARCHAR)) END AS c, CASE WHEN s_suppkey % 5 = 1 THEN concat('s', CAST(s_suppkey AS VARCHAR)) END AS s, CASE WHEN s_suppkey % 5 = 2 THEN concat('x', CAST(s_suppkey AS VARCHAR)) END AS x, CASE WHEN s_suppkey % 5 = 3 THEN concat('new:', replace(upper(s_name), '#', '_')) END AS n FROM
  (SELECT s_suppkey, replace(s_name, '#', '_') AS s_name FROM {supplier}) a) q""")(lambda m: loads.get_or_create(*accession_tables(m)))


def accession_tables(m: Model) -> tuple[DataFrame, ...]:
    names = m["supplier"].select(F.upper(F.replace("s_name", F.lit("#"), F.lit("_"))).alias("accession"), "s_suppkey")
    own = lambda k, mark: names.where(F.col("s_suppkey") % 5 == k).select("accession", F.concat(F.lit(mark), "s_suppkey").alias("entity_id"))
    synonyms = own(1, "s").select("entity_id", F.lower("accession").alias("synonym"))
    return names.select(F.concat("accession", F.lit("-2")).alias("accession")), own(0, "s"), synonyms, own(2, "x"), own(3, "n").select("accession", F.col("accession").alias("canonical_name"))


# --- what a cycle stores -----------------------------------------------------------------------

BATCH = "SELECT *, concat(entity_a, '|', entity_b, '|', interaction_type, '|', effect, '|', direction) AS interaction_id FROM {claims} WHERE line_no >= 4"
entry("literal_claims", "SELECT concat_ws('|', paper_id, CAST(line_no AS VARCHAR), entity_a, entity_b, interaction_type) AS claim_id, paper_id, line_no, entity_a AS entity_a_text, entity_b AS entity_b_text, interaction_type AS interaction_type_text, direction AS direction_text, effect AS effect_text, evidence_type AS evidence_type_text, confidence_score, left(coalesce(snippet, ''), 400) AS snippet FROM {batch}", batch=BATCH)(
    lambda m: writes.literal_claims(m["claims"].where("line_no >= 4"))
)
NULLED = "SELECT entity_a, entity_b, interaction_type, nullif(effect, 'binds') AS effect, direction, evidence_count FROM {interactions}"
entry("interaction_upsert", """SELECT DISTINCT entity_a, entity_b, interaction_type, nullif(effect, 'binds') AS effect, direction, concat_ws('|', entity_a, entity_b, interaction_type, coalesce(nullif(effect, 'binds'), chr(0)), direction) AS id FROM {batch} b
 WHERE NOT EXISTS (SELECT 1 FROM {nulled} i WHERE i.evidence_count > 1 AND i.entity_a = b.entity_a AND i.entity_b = b.entity_b AND i.interaction_type = b.interaction_type AND i.direction = b.direction AND i.effect IS NOT DISTINCT FROM nullif(b.effect, 'binds'))""", batch=BATCH, nulled=NULLED)(
    lambda m: writes.upsert_interactions(*[t.withColumn("effect", F.nullif("effect", F.lit("binds"))) for t in (m["claims"].where("line_no >= 4"), m.stored().interactions.where("evidence_count > 1"))])
)
entry("paper_counts", """SELECT e.id, CAST(e.paper_count + coalesce(n, 0) AS BIGINT) AS paper_count FROM {entities} e LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT paper_id, entity_a AS id FROM {batch} UNION SELECT paper_id, entity_b FROM {batch}) q GROUP BY id) x ON x.id = e.id""", batch=BATCH)(
    lambda m: writes.paper_counts(m["claims"].where("line_no >= 4"), m["entities"]).select("id", "paper_count")
)
entry("extraction_inputs", r"""SELECT doc_id AS id, sha256(CASE WHEN full_used THEN long_text ELSE short_text END) AS digest, full_used AS full_text_used, CASE WHEN length(regexp_replace(CASE WHEN full_used THEN long_text ELSE short_text END, '^\s+|\s+$', '', 'g')) < 50 THEN 'Insufficient text' END AS error FROM (
 SELECT doc_id, short_text, long_text, length(long_text) > length(short_text) AS full_used FROM (SELECT doc_id, left(coalesce(text, ''), 120) AS short_text, CASE WHEN lang = 'en' THEN coalesce(text, '') ELSE '' END AS long_text FROM {documents}) a) b""")(
    lambda m: writes.extraction_inputs(m["documents"].select(F.col("doc_id").alias("id"), F.left("text", F.lit(120)).alias("abstract")), m["documents"].where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("text").alias("full_text"))).select("id", F.sha2("text", 256).alias("digest"), "full_text_used", "error")
)
entry("source_routing", "SELECT event_type, CASE WHEN event_type = 'view' THEN 'semantic_scholar' ELSE 'pubmed' END AS crawler, 'pubmed' AS without_second, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY event_type")(
    lambda m: m["events"].withColumn("api", F.when(F.col("event_type") == "view", "semantic_scholar").when(F.col("event_type") == "click", "pubmed").otherwise(F.col("event_type"))).groupBy("event_type", writes.route(F.col("api")).alias("crawler"), writes.route(F.col("api"), False).alias("without_second")).agg(F.count("*").alias("n"))
)
BUDGETS = """SELECT day, event_type, CAST(taken AS BIGINT) AS taken FROM (WITH RECURSIVE had AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) // 4 AS found FROM {events} GROUP BY 1, 2),
 placed AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_type) AS place, count(*) OVER (PARTITION BY day) AS n FROM had),
 steps AS (SELECT day, CAST(NULL AS VARCHAR) AS event_type, 0 AS place, n, CAST(extract('day' FROM day) AS BIGINT) % 4 * 3 AS pool, CAST(20 AS BIGINT) AS budget, CAST(0 AS BIGINT) AS taken FROM placed WHERE place = 1
  UNION ALL SELECT s.day, p.event_type, s.place + 1, s.n, s.pool + coalesce(p.found, 0) - x.take, s.budget - x.take, x.take FROM steps s LEFT JOIN placed p ON p.day = s.day AND p.place = s.place + 1,
   LATERAL (SELECT CASE WHEN s.place < s.n THEN least(CAST(ceil(s.budget / CAST(s.n - s.place AS DOUBLE)) AS BIGINT), s.pool + p.found) ELSE least(s.budget, s.pool) END AS take) x WHERE s.place <= s.n)
 SELECT * FROM steps WHERE place > 0) q"""


def cycle_budgets(m: Model) -> DataFrame:
    """20 papers a day: a quarter of each type's events are papers that a search brings, and some wait from the day before."""
    day = F.date_trunc("day", "ts").alias("day")
    found = m["events"].groupBy(day, "event_type").agg(F.floor(F.count("*") / 4).alias("found"))
    waiting = m["events"].select(day).distinct().withColumn("waiting", F.dayofmonth("day") % 4 * 3)
    return writes.budgets(found, "day", "event_type", "found", 20, waiting)


entry("cycle_budgets", BUDGETS)(cycle_budgets)
entry("extraction_status", """SELECT id, CASE WHEN source_key % 3 = 0 THEN 'failed' WHEN source_key % 3 = 1 THEN 'done' ELSE status END AS extraction_status, CASE WHEN source_key % 3 = 0 THEN 2000 ELSE 3 END AS error_length FROM {papers}""")(
    lambda m: writes.extraction_status(m["papers"].select("id", F.col("status").alias("extraction_status"), F.lit("old").alias("extraction_error")), m["papers"].where("source_key % 3 < 2").select("id", (F.col("source_key") % 3 == 1).alias("ok"), F.repeat(F.lit("x"), F.lit(3000)).alias("error"))).select("id", "extraction_status", F.length("extraction_error").alias("error_length"))
)
MOVED = """SELECT id, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'failed' END AS next, status FROM {searches}"""
entry("search_transitions", """SELECT s.id, CASE WHEN ok THEN next ELSE s.status END AS status, CASE WHEN ok AND next = 'done' THEN s.papers_new % 4 ELSE s.papers_new END AS papers_new, CAST(CASE WHEN ok AND next = 'done' THEN CASE WHEN s.papers_new % 4 > 0 THEN 1 ELSE 0 END ELSE improved END AS INT) AS improved, CASE WHEN ok AND next = 'failed' THEN 'timeout' END AS last_error
 FROM {searches} s JOIN (SELECT *, next = 'running' AND status = 'pending' OR next IN ('done', 'failed') AND status IN ('pending', 'running') AS ok FROM {moved}) x ON x.id = s.id""", moved=MOVED)(
    lambda m: writes.transition(m["searches"], m["searches"].select("id", F.when(F.col("id") % 3 == 0, "running").when(F.col("id") % 3 == 1, "done").otherwise("failed").alias("status"), (F.col("papers_new") % 4).alias("papers_new"), F.lit("timeout").alias("error"))).select("id", "status", "papers_new", "improved", "last_error")
)
entry("verification_update", "SELECT id, CASE WHEN year % 2 = 0 THEN 'verified' END AS verification_status, CASE WHEN year % 2 = 0 THEN nullif(confidence_score, 1) ELSE verification_score END AS verification_score, CASE WHEN year % 2 = 0 THEN 500 END AS notes_length FROM {evidence}")(
    lambda m: writes.update(m["evidence"].select("id", F.lit(None).cast("string").alias("verification_status"), "verification_score", F.lit(None).cast("string").alias("verification_notes")), m["evidence"].where("year % 2 = 0").select("id", F.lit("verified").alias("verification_status"), F.nullif("confidence_score", F.lit(1.0)).alias("verification_score"), F.repeat(F.lit("n"), F.lit(600)).alias("verification_notes")), "id", ("verification_status", "verification_score", "verification_notes"), limits={"verification_notes": writes.NOTES})
    .select("id", "verification_status", "verification_score", F.length("verification_notes").alias("notes_length"))
)
entry("planning_update", "SELECT id, CASE WHEN status = 'pending' THEN round(papers_new / 2.0::DOUBLE, 4) END AS planning_score, CASE WHEN status = 'pending' THEN concat('{\"prior_signal\":', CAST(papers_new AS VARCHAR), '}') END AS planning_factors FROM {searches}")(
    lambda m: writes.update(m["searches"].select("id", F.lit(None).cast("double").alias("planning_score"), F.lit(None).cast("string").alias("planning_factors")), m["searches"].where("status = 'pending'").select("id", F.round(F.col("papers_new") / 2, 4).alias("planning_score"), F.to_json(F.struct(F.col("papers_new").alias("prior_signal"))).alias("planning_factors")), "id", ("planning_score", "planning_factors"))
)
entry("conflict_status_update", "SELECT id, CASE WHEN conflict_type = 'ambiguous' THEN 'investigating' ELSE status END AS status, conflict_type, CASE WHEN conflict_type = 'ambiguous' THEN 0::DOUBLE ELSE penalty_weight END AS penalty_weight FROM {conflicts}", **CF)(
    lambda m: writes.update(detected(m).select("id", "status", "conflict_type", "penalty_weight"), detected(m).where("conflict_type = 'ambiguous'").select("id", F.lit("investigating").alias("status"), F.lit("").alias("conflict_type"), F.lit(0.0).alias("penalty_weight")), "id", ("penalty_weight",), ("status", "conflict_type"))
)
entry("conflict_generated_ids", "SELECT id, CASE WHEN conflict_type = 'ambiguous' THEN concat('q0,q1,', interaction_a) ELSE 'q0' END AS generated_ids FROM {conflicts}", **CF)(
    lambda m: writes.add_ids(detected(m).select("id", F.array(F.lit("q0")).alias("generated_ids")), detected(m).where("conflict_type = 'ambiguous'").select("id", F.explode(F.array(F.lit("q1"), F.lit("q0"), "interaction_a", "interaction_a")).alias("query_id"))).withColumn("generated_ids", F.array_join("generated_ids", ","))
)
entry("seed_queries", "SELECT DISTINCT c_name AS query_text, 'pubmed' AS source_api FROM {customer} WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0")(
    lambda m: writes.seed_queries(m["customer"].select(F.col("c_name").alias("query_text"), F.lit("pubmed").alias("source_api")), m["customer"].where("c_custkey % 2 = 1").select(F.col("c_name").alias("query_text"), F.lit("pubmed").alias("source_api"), F.when(F.col("c_custkey") % 5 == 0, "failed").when(F.col("c_custkey") % 3 == 0, "running").otherwise("done").alias("status")))
)
entry("phase_telemetry", "SELECT date_trunc('day', ts) AS day, event_type AS name, CAST(sum(event_id % 7) AS BIGINT) AS value FROM {events} GROUP BY 1, 2")(
    lambda m: writes.telemetry(m["events"].select(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("name"), (F.col("event_id") % 7).alias("value")), "day")
)

# --- reprocessing ------------------------------------------------------------------------------

entry("reprocess_evidence", """SELECT e.id, a.canonical_name AS name_a, b.canonical_name AS name_b, e.interaction_type, CASE WHEN e.evidence_type = 'cited_claim' THEN 'cited_claim' ELSE e.evidence_type END AS evidence_type, e.adjudication_score, CASE WHEN e.year % 2 = 0 THEN 'c1' ELSE concat('claim:', e.id) END AS claim_id FROM {adjudicated} e
 JOIN {entities} a ON a.id = e.entity_a JOIN {entities} b ON b.id = e.entity_b""", **EV)(lambda m: backfilled(m).select("id", "name_a", "name_b", "interaction_type", "evidence_type", "adjudication_score", "claim_id"))  # fmt: skip
entry("reprocess_claims", """SELECT concat('claim:', e.id) AS claim_id, paper_id, a.canonical_name AS entity_a_text, b.canonical_name AS entity_b_text, interaction_type AS interaction_type_text, direction AS direction_text, effect AS effect_text, confidence_score, coalesce(snippet, '') AS snippet FROM {evidence} e
 JOIN {entities} a ON a.id = e.entity_a JOIN {entities} b ON b.id = e.entity_b WHERE year % 2 = 1""")(lambda m: reprocess.backfilled_claims(backfilled(m)))  # fmt: skip
entry("enum_coercion", "SELECT interaction_type, effect, CASE WHEN effect = 'binds' THEN 'unknown' ELSE interaction_type END AS kind, CAST(count(*) AS BIGINT) AS n FROM {claims} GROUP BY interaction_type, effect")(
    lambda m: m["claims"].groupBy("interaction_type", "effect").agg(F.count("*").alias("n")).withColumn("kind", reprocess.coerce(F.when(F.col("effect") == "binds", "regulatory").otherwise(F.col("interaction_type")), reprocess.INTERACTION_TYPES))
)
entry("conflicts_refreshed", "SELECT * FROM {resolved}", **CF, outcomes=OUTCOMES, resolved=RESOLVED)(
    lambda m: reprocess.refresh(detected(m).where("conflict_axis = 'direction'"), m.contested.interactions, confidence.with_contexts(m.contested["evidence"])).drop("conflict_axis")
)


def backfilled(m: Model) -> DataFrame:
    """Evidence of even years has a claim."""
    own = m.stored()["evidence"].withColumn("claim_id", F.when(F.col("year") % 2 == 0, "c1"))
    return reprocess.backfill(reprocess.joined(own, m.interactions, m["papers"], m["entities"]))


# --- model output ------------------------------------------------------------------------------


def outputs(m: Model) -> DataFrame:
    """Claims as a model would say them: one call for each in one of three forms, with odd entries beside; the text supports every second snippet."""
    snippet = F.format_string("we found that %s changes %s in %s", "entity_a", "entity_b", "paper_id")
    own = F.struct(
        "entity_a", "entity_b", F.when(F.col("effect") == "activates", "Phosphorylation").otherwise("Direct Binding").alias("interaction_type"), F.upper("direction").alias("direction"), F.nullif("effect", F.lit("binds")).alias("effect"),
        F.when(F.col("line_no") == 5, "Danio rerio").otherwise("human").alias("organism"), F.when(F.col("line_no") == 2, "certain").otherwise("HIGH").alias("confidence"),
        F.when(F.col("line_no") == 3, "n/a").when(F.col("line_no") == 4, "7").otherwise(F.col("confidence_score").cast("string")).alias("confidence_score"), snippet.alias("snippet"),
    )
    nameless = own.withField("entity_b", F.lit(""))
    said = F.to_json(F.struct(F.array(own, nameless).alias("interactions"), F.array(F.struct(F.col("entity_a").alias("name"), F.lit("Transcription Factor").alias("entity_type")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("gene").alias("entity_type"))).alias("entities")))
    parts = F.to_json(F.struct(F.array(own).alias("x")))
    listed = F.expr("substring(parts, 6, length(parts) - 6)")
    rows = m["claims"].select("paper_id", "line_no", "entity_a", "entity_b", said.alias("said"), parts.alias("parts"), F.when(F.length("paper_id") % 2 == 0, F.concat(F.lit("As shown, "), F.upper(snippet), F.lit("."))).otherwise(F.lit("0123456789 " * 20)).alias("text"))
    form = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("<think>{</think><tool_call><function=save><parameter=interactions>"), listed, F.lit("</parameter></function></tool_call>")))
    form = form.when(F.col("line_no") % 3 == 1, F.concat(F.lit('<tool_call>{"name": "save", "arguments": '), "said", F.lit("}</tool_call>"))).otherwise(F.concat(F.lit("Here it is: "), "said"))
    return output.parse_calls(rows.withColumn("form", form), "form")


SAID = """SELECT paper_id, entity_a, entity_b, CASE WHEN effect = 'activates' THEN 'post_translational' ELSE 'direct_binding' END AS interaction_type, lower(direction) AS direction, nullif(effect, 'binds') AS effect,
 CASE WHEN length(paper_id) % 2 = 1 OR line_no = 2 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN length(paper_id) % 2 = 1 THEN least(0.3::DOUBLE, score) ELSE score END AS confidence_score
 FROM (SELECT *, CASE WHEN line_no = 3 THEN 0.3::DOUBLE WHEN line_no = 4 THEN 1::DOUBLE ELSE confidence_score END AS score FROM {claims} WHERE line_no <> 5) q"""
entry("output_interactions", SAID)(lambda m: output.interactions(outputs(m)).select("paper_id", "entity_a", "entity_b", "interaction_type", "direction", "effect", "confidence", "confidence_score"))
entry("output_entities", "SELECT paper_id, entity_a AS name, 'protein' AS entity_type, CAST(0 AS INT) AS n_synonyms FROM {claims} WHERE line_no % 3 <> 0")(lambda m: output.entities(outputs(m)).select("paper_id", "name", "entity_type", F.size("synonyms").alias("n_synonyms")))

# --- entries, answers, full texts --------------------------------------------------------------


def entity_json(m: Model) -> DataFrame:
    """Parts as database entries: with genes but for every fifth size, whose names differ from the full name in case only."""
    value = lambda c: F.struct(c.alias("value"))
    gene = F.struct(value(F.col("p_brand")).alias("geneName"), F.array(value(F.col("p_name")), value(F.lit(""))).alias("synonyms"))
    name = F.struct(F.struct(value(F.upper("p_name")).alias("fullName"), F.array(value(F.lit("short"))).alias("shortNames")).alias("recommendedName"))
    return m["part"].select(F.to_json(F.struct(F.concat(F.lit("P"), "p_partkey").alias("primaryAccession"), F.when(F.col("p_size") % 5 != 0, F.array(gene)).alias("genes"), F.when(F.col("p_size") % 7 != 0, name).alias("proteinDescription"))).alias("entry"))


entry("entry_entities", """SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS accession, CASE WHEN p_size % 5 <> 0 THEN p_brand WHEN p_size % 7 <> 0 THEN upper(p_name) ELSE concat('P', CAST(p_partkey AS VARCHAR)) END AS canonical_name,
 CASE WHEN p_size % 5 <> 0 THEN concat(p_brand, ';', p_name, CASE WHEN p_size % 7 <> 0 THEN ';short' ELSE '' END) WHEN p_size % 7 <> 0 THEN concat(upper(p_name), ';short') ELSE '' END AS synonyms FROM {part}""")(
    lambda m: entries.entry_entities(entity_json(m)).select("accession", "canonical_name", F.array_join("synonyms", ";").alias("synonyms"))
)
TAXA = (9606, 10090, 10116, 9913, 9823, 9615, 9544, 9986, 10036, 9685, 9796, 9483, 9940, 30521)
entry("resolver_answers", """SELECT name, arg_min(canonical_name, struct_pack(a := rnk, b := place, c := canonical_name, d := accession)) AS canonical_name, arg_min(accession, struct_pack(a := rnk, b := place, c := canonical_name, d := accession)) AS accession, source FROM (
 SELECT entity_b AS name, entity_a AS canonical_name, paper_id AS accession, line_no AS place, CASE WHEN interaction_type = 'transcriptional' THEN 'chebi' ELSE 'uniprot' END AS source, CASE WHEN interaction_type = 'transcriptional' THEN 0 WHEN effect = 'activates' THEN 0 WHEN effect = 'inhibits' THEN 1 ELSE 2 END AS rnk FROM {claims}) q GROUP BY name, source""")(
    lambda m: entries.chosen_answers(m["claims"].select(F.col("entity_b").alias("name"), entries.resolver_of(F.when(F.col("interaction_type") == "transcriptional", "metabolite").otherwise("gene")).alias("source"), F.col("line_no").alias("place"), F.when(F.col("effect") == "activates", 9606).when(F.col("effect") == "inhibits", 10116).otherwise(7955).alias("taxon"), F.col("entity_a").alias("canonical_name"), F.col("paper_id").alias("accession")), TAXA)
)
entry("search_results", """SELECT CASE WHEN p_size % 2 = 0 THEN concat('pmid:', CAST(p_partkey AS VARCHAR)) ELSE concat('s2:h', CAST(p_partkey AS VARCHAR)) END AS id, p_name AS title, 'Roe' AS authors, CAST(p_size AS INT) AS year FROM {part} WHERE p_size % 9 <> 0""")(
    lambda m: entries.search_results(m["part"].select(F.to_json(F.struct(F.concat(F.lit("h"), "p_partkey").alias("paperId"), F.when(F.col("p_size") % 9 != 0, F.col("p_name")).alias("title"), F.col("p_size").cast("int").alias("year"), F.array(F.struct(F.lit("Roe").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).alias("PubMed")).alias("externalIds"))).alias("result"))).select("id", "title", F.array_join("authors", ";").alias("authors"), "year")
)


def article_markup(m: Model) -> DataFrame:
    """Parts as articles: nested sections, markup inside paragraphs, a list, and elements that are no text; some aren't closed, some have ends
    that nothing began, unclosed paragraphs and bare signs, and some have no markup."""
    key = F.col("p_partkey") % 6
    body = F.format_string(
        "<article><front><article-title>On <i>%s</i></article-title><abstract><p>%s%s</p></abstract><kwd-group><p>no</p></kwd-group></front><body><sec><title>One</title><p>a <b>%s</b> c%s<fig><p>no</p></fig>"
        "<sec><title>Two</title><list><item><p>x</p></item><item><p>y</p></item></list></sec></sec><p>%s</p></body>%s", "p_name", "p_type", F.when(key == 2, "</sup> 1 < 2 & 3").otherwise(""), "p_brand", F.when(key == 3, "</p></wrong>").otherwise("</p>"), F.repeat(F.lit("end "), F.col("p_size").cast("int")), F.when(key != 1, "</article>").otherwise(""),
    )
    return m["part"].select(F.col("p_partkey").alias("id"), F.when(key == 4, F.concat(F.repeat(F.lit("plain "), F.lit(50)), "p_name")).otherwise(body).alias("xml"))


entry("full_texts", """SELECT id, full_text FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 4 THEN concat(repeat('plain ', 50), p_name) ELSE concat('TITLE: On ', p_name, nn, 'ABSTRACT:', chr(10), p_type, CASE WHEN p_partkey % 6 = 2 THEN ' 1 < 2 & 3' ELSE '' END, nn, 'One', nn, 'a ', p_brand, ' c', nn, 'Two', nn, 'x', nn, 'y', nn, trim(repeat('end ', p_size))) END AS full_text
 FROM (SELECT *, chr(10) || chr(10) AS nn FROM {part}) a) q WHERE length(full_text) > 200""")(lambda m: entries.full_texts(article_markup(m)))  # fmt: skip

# --- names, caches, small reads ----------------------------------------------------------------

entry("graph_names", """SELECT m.name, CASE WHEN n = 1 THEN x.id END AS entity_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM (SELECT name FROM {mentions} UNION ALL SELECT concat(p_type, ' nowhere') FROM {part}) m LEFT JOIN (SELECT synonym, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM {synonyms} GROUP BY synonym) x ON x.synonym = lower(trim(m.name))""", mentions=MENTIONS)(
    lambda m: lookups.resolved_names(mentions(m).select("name").unionAll(m["part"].select(F.concat("p_type", F.lit(" nowhere")))), m["synonyms"])
)
entry("propagation_cached", graph_sql.propagate(["s0", "s1", "s2"], ["suppress", "promote"], 1).replace("arrivals FROM", "arrivals, run IN ('s0:suppress', 's0:promote') AS hit FROM", 1), arcs=ARCS)(lambda m: cached(m))


def cached(m: Model) -> DataFrame:
    """Requests of depth 1 for three seeds: a cached one, one whose cache expired, and one that isn't cached."""
    edges, spark = all_arcs(m), m.spark
    asked = spark.createDataFrame([(s, mode, 1) for s in ("s0", "s1", "s2") for mode in ("suppress", "promote")], "seed string, mode string, depth int")
    cache = spark.createDataFrame([(s, mode, 2, until) for s, until in (("s0", 10), ("s1", 1)) for mode in ("suppress", "promote")], "seed string, mode string, max_depth int, expires int")
    runs = cache.select(F.concat_ws(":", "seed", "mode").alias("run"), F.col("seed").alias("entity"), F.when(F.col("mode") == "suppress", -1.0).otherwise(1.0).alias("score"))
    stored = graph.arrivals(edges, runs, 2)[0].select(F.split_part("run", F.lit(":"), F.lit(1)).alias("seed"), F.split_part("run", F.lit(":"), F.lit(2)).alias("mode"), "target", "score", "hop")
    return graph.cached_or_computed(asked, cache, stored, edges, 5)


entry("visible_edges", "SELECT id, effect FROM {interactions} WHERE effect <> 'binds'")(lambda m: lookups.visible_edges(m.stored().interactions.withColumn("effect", F.when(F.col("effect") != "binds", F.col("effect")).when(F.col("direction") == "undirected", "unknown"))).select("id", "effect"))
entry("pending_queries", "SELECT id, planning_score FROM (SELECT id, completed_at, CASE WHEN papers_new > 20 THEN CAST(papers_new AS DOUBLE) END AS planning_score FROM {searches} WHERE status = 'pending') q ORDER BY planning_score DESC NULLS LAST, completed_at, id LIMIT 30")(
    lambda m: lookups.pending_queries(m["searches"].withColumn("planning_score", F.when(F.col("papers_new") > 20, F.col("papers_new").cast("double"))), 30).select("id", "planning_score")
)
entry("pending_candidates", "SELECT id, completed_at FROM {searches} WHERE status = 'pending' ORDER BY completed_at, id LIMIT 125")(lambda m: lookups.pending_candidates(m["searches"], 25).select("id", "completed_at"))
entry("conflict_queue", "SELECT id, conflict_type, penalty_weight FROM {conflicts} WHERE conflict_type = 'ambiguous' ORDER BY penalty_weight DESC, id LIMIT 10", **CF)(lambda m: lookups.conflict_queue(detected(m), 10, None, "ambiguous").select("id", "conflict_type", "penalty_weight"))
entry("open_conflicts", "SELECT id, status, penalty_weight FROM {conflicts} ORDER BY penalty_weight DESC, id LIMIT 20", **CF)(lambda m: lookups.open_conflicts(detected(m), 20).select("id", "status", "penalty_weight"))
entry("latest_search", "SELECT id, query_type, status FROM {searches} ORDER BY id DESC LIMIT 1")(lambda m: lookups.latest(m["searches"], "id").select("id", "query_type", "status"))
entry("entity_by_id", "SELECT * FROM {entities} WHERE id = 's3'")(lambda m: lookups.by_key(m["entities"], "id", "s3"))
entry("names_by_type", "SELECT id, canonical_name FROM {entities} WHERE entity_type = 'metabolite' UNION ALL SELECT id, canonical_name FROM {entities}")(lambda m: lookups.names_of_type(m["entities"], "metabolite").unionAll(lookups.names_of_type(m["entities"])))
entry("synonym_detail", """SELECT s.synonym, e.id, e.canonical_name, e.entity_type, e.paper_count FROM {synonyms} s JOIN {entities} e ON e.id = s.entity_id WHERE s.synonym IN (SELECT synonym FROM (SELECT synonym, count(DISTINCT x.id) AS n, sum(paper_count) AS p FROM {synonyms} y JOIN {entities} x ON x.id = y.entity_id GROUP BY synonym HAVING count(DISTINCT x.id) > 1 ORDER BY n DESC, p DESC, synonym LIMIT 50) q)""")(
    lambda m: lookups.synonym_detail(m["entities"], m["synonyms"])
)
entry("evidence_drawer", "SELECT e.id, e.paper_id, e.year, p.priority, p.status, e.evidence_type, e.confidence_score FROM {evidence} e JOIN {papers} p ON p.id = e.paper_id WHERE e.interaction_id = (SELECT min(id) FROM {interactions} WHERE evidence_count = (SELECT max(evidence_count) FROM {interactions}))")(
    lambda m: lookups.drawer(m["evidence"], m["papers"], (m.stored().interactions.orderBy(F.desc("evidence_count"), "id").first() or {"id": ""})["id"])
)
entry("affected_top", "SELECT seed, mode, CAST(place AS INT) AS place, target, score FROM (SELECT *, row_number() OVER (PARTITION BY seed, mode ORDER BY abs(score) DESC, target) AS place FROM (" + graph_sql.propagate(["s0", "s1"], ["suppress"], 2) + ") p) q WHERE place <= 10", arcs=ARCS)(
    lambda m: lookups.strongest_affected(graph.propagate(all_arcs(m), ["s0", "s1"], ("suppress",), 2))
)
entry("evidence_of_paper", "SELECT id, interaction_id FROM {evidence} WHERE paper_id = (SELECT min(id) FROM {papers})")(lambda m: lookups.optional(m["evidence"], paper_id=m["papers"].agg(F.min("id")).first()[0]).select("id", "interaction_id"))

# --- histories, analysis, verification ---------------------------------------------------------

entry("cycle_score_history", """SELECT day AS cycle, score, round(score - lag(score) OVER (ORDER BY day), 4) AS change FROM (SELECT date_trunc('day', completed_at) AS day, round(CAST(count(*) AS DOUBLE) * sum(new_interactions) / (1 + sum(improved)), 4) AS score FROM {searches} GROUP BY 1) q""")(
    lambda m: history.score_history(m["searches"].groupBy(F.date_trunc("day", "completed_at").alias("cycle")).agg(F.count("*").alias("entities"), F.sum("new_interactions").alias("interactions"), F.sum("improved").alias("conflict_weight")))
)
CHOSEN = "SELECT * FROM {stated} WHERE status IN ('open', 'reopened') ORDER BY penalty_weight DESC, id LIMIT 200"
ANALYSED = """SELECT c.id, CASE WHEN settled THEN c.recommended WHEN asked THEN kind ELSE c.conflict_type END AS conflict_type, CASE WHEN settled THEN 'resolved' ELSE c.status END AS status, CASE WHEN settled THEN c.settled_weight WHEN asked THEN weight ELSE c.penalty_weight END AS penalty_weight,
 CASE WHEN settled THEN CASE WHEN recommended = 'true_conflict' THEN 'gap' ELSE 'contexts' END WHEN asked THEN concat('because of ', c.id) END AS analysis
 FROM (SELECT s.*, recommended, o.penalty_weight AS settled_weight, h.id IS NOT NULL AND o.id IS NOT NULL AS settled, h.id IS NOT NULL AND o.id IS NULL AND s.conflict_type = 'ambiguous' AND s.interaction_a < 's7' AS asked,
  CASE WHEN length(s.id) % 2 = 0 THEN 'true_conflict' ELSE 'ambiguous' END AS kind, CASE WHEN length(s.id) % 4 < 2 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM {stated} s LEFT JOIN {chosen} h ON h.id = s.id LEFT JOIN {outcomes} o ON o.id = s.id) c"""


def analysed(m: Model) -> DataFrame:
    """The 200 heaviest open conflicts analysed; the answers are a function of ids, and some conflicts get none."""
    def answers(rows: DataFrame) -> DataFrame:
        n = F.length("id")
        verdict, weight = F.when(n % 2 == 0, "true_conflict"), F.when(n % 4 < 2, 0.9)
        return rows.where("interaction_a < 's7'").select("id", verdict.alias("verdict"), weight.alias("weight"), F.concat(F.lit("because of "), "id").alias("reasons"))

    out = conflicts.analyse(stated(m), grounds(m), answers, 200)
    settled = {text: "gap" if which == "true" else "contexts" for which, text in conflicts.NOTES.items()}
    short = F.coalesce(F.create_map(*[F.lit(x) for pair in settled.items() for x in pair])[F.col("analysis")], "analysis")
    return out.select("id", "conflict_type", "status", "penalty_weight", short.alias("analysis"))


entry("conflicts_analysed", ANALYSED, **CF, stated=STATED, chosen=CHOSEN, outcomes=OUTCOMES)(analysed)
entry("conflict_view_entity", """SELECT c.id AS conflict, c.conflict_type, c.penalty_weight, a.effect AS effect_a, b.effect AS effect_b, e1.canonical_name AS a_left, e2.canonical_name AS a_right, e3.canonical_name AS b_left, e4.canonical_name AS b_right
 FROM {stated} c JOIN {interactions} a ON a.id = c.interaction_a JOIN {interactions} b ON b.id = c.interaction_b JOIN {entities} e1 ON e1.id = a.entity_a JOIN {entities} e2 ON e2.id = a.entity_b JOIN {entities} e3 ON e3.id = b.entity_a JOIN {entities} e4 ON e4.id = b.entity_b
 WHERE 's3' IN (a.entity_a, a.entity_b) AND c.status IN ('open', 'reopened', 'investigating') ORDER BY c.penalty_weight DESC, c.id LIMIT 50""", **CF, stated=STATED)(lambda m: conflicts.view(stated(m), m.contested.interactions, m["entities"], 50, "s3"))  # fmt: skip
STATUS = "SELECT *, CASE WHEN verification_score < 0.3 THEN 'needs_review' WHEN verification_score >= 0.6 THEN 'verified' END AS verification_status FROM {evidence}"
BY_STATUS = "SELECT id, interaction_id, confidence_score FROM {checked} WHERE (verification_status IS NULL OR verification_status = 'needs_review') AND interaction_id IN (SELECT interaction_a FROM {stated} WHERE status IN ('open', 'reopened', 'investigating') UNION SELECT interaction_b FROM {stated} WHERE status IN ('open', 'reopened', 'investigating')) ORDER BY confidence_score DESC, id LIMIT 25"


def candidates_by_status(m: Model) -> DataFrame:
    status = F.when(F.col("verification_score") < 0.3, "needs_review").when(F.col("verification_score") >= 0.6, "verified")
    return conflicts.to_verify(m.contested["evidence"].withColumn("verification_status", status), stated(m))


entry("verification_by_status", BY_STATUS, **CF, stated=STATED, checked=STATUS)(candidates_by_status)
entry("verification_phase", "SELECT v.id, v.check_status AS verification_status, v.check_score AS verification_score FROM ({verified}) v WHERE v.id IN (SELECT id FROM ({picked}) p)".replace("({verified})", "{verified}").replace("({picked})", "{picked}"), **CF, stated=STATED, checked=STATUS, picked=BY_STATUS, verified=VERIFY)(lambda m: verification_phase(m))


def verification_phase(m: Model) -> DataFrame:
    """The candidates' evidence, checked against its snippet, as it is after the update. All candidates are contested."""
    picked = candidates_by_status(m).select("id")
    rows = m.contested["evidence"].join(picked, "id", "left_semi").select("id", "effect", "organism", F.col("tissue_cell_type").alias("tissue"), "condition", "direction", F.col("entity_a").alias("name_a"), F.col("entity_b").alias("name_b"), "snippet", F.lit(None).cast("string").alias("source"))
    checked = text.verify(rows).select("id", F.col("check_status").alias("verification_status"), F.col("check_score").alias("verification_score"), F.col("check_notes").alias("verification_notes"))
    old = m.contested["evidence"].select("id", F.lit(None).cast("string").alias("verification_status"), "verification_score", F.lit(None).cast("string").alias("verification_notes"))
    after = writes.update(old, checked, "id", ("verification_status", "verification_score", "verification_notes"), limits={"verification_notes": writes.NOTES})
    return after.where("verification_status IS NOT NULL").select("id", "verification_status", "verification_score")


entry("verify_gate", """SELECT id, confidence_score >= 0.55 OR direction = 'bidirectional' AS gate, CASE WHEN organism IS NULL THEN 'effect,direction' ELSE 'effect,direction,organism' END AS required, CASE WHEN organism IS NOT NULL AND tissue_cell_type IS NULL THEN 'needs_review' ELSE 'verified' END AS status FROM {evidence}""")(
    lambda m: m["evidence"].select("id", text.should_verify(F.col("confidence_score"), F.col("direction") == "bidirectional").alias("gate"), text.required_fields("organism").alias("needs"), F.create_map(F.lit("effect"), F.lit(True), F.lit("direction"), F.lit(True), F.lit("organism"), F.col("tissue_cell_type").isNotNull()).alias("fields"))
    .select("id", "gate", F.array_join("needs", ",").alias("required"), text.supported_status(F.lit("verified"), F.col("fields"), F.col("needs")).alias("status"))
)
entry("evidence_prompt", """SELECT interaction_id, string_agg(concat(paper_id, ' | ', evidence_type, ' | ', printf('%.2f', confidence_score)), chr(10) ORDER BY place) AS prompt
 FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY adjudication_score DESC, id) AS place FROM {adjudicated}) q WHERE place <= 5 GROUP BY interaction_id""", **EV)(
    lambda m: confidence.first_lines(adjudicated(m)).groupBy("interaction_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
)
entry("cache_warm", """SELECT seed, mode FROM (SELECT x.id AS seed, unnest(['suppress', 'promote']) AS mode FROM (SELECT entity AS id, count(*) AS n FROM (SELECT DISTINCT entity, id FROM {ends}) d GROUP BY entity ORDER BY n DESC, entity LIMIT 20) x) q WHERE NOT (seed IN (SELECT concat('s', CAST(s_suppkey AS VARCHAR)) FROM {supplier} WHERE s_suppkey % 3 = 0) AND mode = 'suppress')""", **DEG)(
    lambda m: graph.to_warm(lookups.top_degree(m["entities"], m.stored().interactions, 20), m["supplier"].select(F.concat(F.lit("s"), "s_suppkey").alias("seed"), F.when(F.col("s_suppkey") % 3 == 0, "suppress").otherwise("promote").alias("mode"), F.lit(3).alias("max_depth"), F.when(F.col("s_suppkey") % 3 == 0, 9).otherwise(1).alias("expires")), 3, 5)
)
entry("resolve_store", STORE_EXACT, mentions=MENTIONS, shared=SHARED)(lambda m: resolve.exact(mentions(m), m["entities"], shared_names(m), resolve.STORE_RUNGS))
entry("path_nodes", "SELECT path, CAST(i - 1 AS INT) AS place, e.id, e.canonical_name AS name, e.entity_type FROM (SELECT path, unnest(range(1, len(nodes) + 1)) AS i, nodes FROM (SELECT path, string_split(path, '>') AS nodes FROM (" + graph_sql.paths("s0", "s1", 4, 50, 0.93) + ") p) q) r JOIN {entities} e ON e.id = nodes[i]", arcs=ARCS)(
    lambda m: lookups.path_nodes(graph.paths(all_arcs(m), "s0", "s1", 4, 50, 0.93), m["entities"].withColumn("display_name", F.lit("")))
)


# --- cache, assays, cycle ----------------------------------------------------------------------

WARM = [f"s{i}" for i in range(4)]


def warmed(m: Model) -> tuple[DataFrame, DataFrame]:
    """A warm-up of four entities to depth 2: a result that is there, one that isn't as deep, one that expired, and one that is missing."""
    spark, now = m.spark, F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [("s0", "suppress", 3, "2024-01-03 00:00:00", 7), ("s1", "suppress", 1, "2024-01-03 00:00:00", 7), ("s2", "promote", 3, "2024-01-01 00:00:00", 7)]
    cache = spark.createDataFrame(rows, "seed string, mode string, max_depth int, expires string, hits long").withColumn("expires", F.col("expires").cast("timestamp"))
    stored = spark.createDataFrame([("s0", "suppress", "p1", 0.5, 1), ("s1", "suppress", "p1", 0.5, 1)], "seed string, mode string, target string, score double, hop int")
    return warming.warm(spark.createDataFrame([(s,) for s in WARM], "id string"), cache, stored, all_arcs(m), 2, now)


def cache_warmed(m: Model) -> DataFrame:
    cache, stored = warmed(m)
    asked = m.spark.createDataFrame([("s0", "suppress", 3), ("s0", "suppress", 2), ("s3", "promote", 3), ("s3", "promote", 1)], "seed string, mode string, depth int")
    counted = warming.count_hits(cache, asked, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    sizes = stored.groupBy("seed", "mode").agg(F.count("*").alias("stored"), F.round(F.sum("score"), 6).alias("total"))
    return counted.join(sizes, ["seed", "mode"], "left").select("seed", "mode", "max_depth", "expires", "hits", F.coalesce("stored", F.lit(0)).alias("stored"), "total")


entry("cache_warmed", "SELECT c.seed, c.mode, max_depth, expires, CAST(hits AS BIGINT) AS hits, CAST(CASE WHEN max_depth = 3 THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS stored, CASE WHEN max_depth = 3 THEN 0.5 ELSE total END AS total FROM (SELECT s.seed, m.mode, CASE WHEN s.seed = 's0' AND m.mode = 'suppress' THEN 3 ELSE 2 END AS max_depth, TIMESTAMP '2024-01-03 00:00:00' AS expires, CASE WHEN s.seed = 's0' AND m.mode = 'suppress' THEN 9 WHEN s.seed = 's3' AND m.mode = 'promote' THEN 1 ELSE 0 END AS hits FROM (VALUES ('s0'), ('s1'), ('s2'), ('s3')) s(seed), (VALUES ('suppress'), ('promote')) m(mode)) c LEFT JOIN ("
      + graph_sql.arrivals(WARM, ["suppress", "promote"], 2) + ") a ON a.seed = c.seed AND a.mode = c.mode", arcs=ARCS)(cache_warmed)


def query_log(m: Model) -> DataFrame:
    edges, now = all_arcs(m), F.lit("2024-01-02 00:00:00").cast("timestamp")
    asked = m.spark.createDataFrame([("s0", "promote", 2), ("s1", "promote", 2), ("nowhere", "promote", 2)], "seed string, mode string, depth int")
    return warming.log_rows(asked, graph.propagate(edges, ["s0", "s1", "nowhere"], ("promote",), 2), m["entities"], now)


entry("query_log", "SELECT e.canonical_name AS entity_name, 'promote' AS mode, 2 AS depth, CAST(coalesce(n, 0) AS BIGINT) AS result_count, TIMESTAMP '2024-01-02 00:00:00' AS created_at FROM (VALUES ('s0'), ('s1'), ('nowhere')) s(seed) LEFT JOIN (SELECT seed, count(*) AS n FROM ("
      + graph_sql.propagate(["s0", "s1"], ["promote"], 2) + ") p GROUP BY seed) a ON a.seed = s.seed LEFT JOIN {entities} e ON e.id = s.seed", arcs=ARCS)(query_log)


def assays(m: Model) -> DataFrame:
    kind, way = F.col("evidence_type"), F.col("direction")
    assay = F.when(kind == "structural", "Cryo-EM map").when(kind == "in_vitro", " Co-IP, then immunoblot").when(kind == "in_vivo", "")
    rows = m["evidence"].withColumns({"assay_type": assay, "evidence_subtype": F.when(way == "A_to_B", "RNAseq of cells").when(way == "B_to_A", "yeast two-hybrid!")})
    return confidence.with_contexts(rows).select("id", "norm_assay")


entry("evidence_assays", """SELECT id, CASE evidence_type WHEN 'structural' THEN 'structure:cryo_em' WHEN 'in_vitro' THEN 'protein_interaction:coip' ELSE CASE direction WHEN 'A_to_B' THEN 'expression:rnaseq' WHEN 'B_to_A' THEN 'assay:yeast_two_hybrid' END END AS norm_assay FROM {evidence}""")(assays)


def cycled(m: Model) -> cycle.Tables:
    """All claims taken in by two cycles, with ids for names; once a folder and application."""
    key = m.spark.sparkContext.applicationId, m.sf_dir
    if key not in CYCLED:
        folder = f"{shared_dir(m.spark).rstrip('/')}/cycle-{uuid.uuid4().hex}"
        t = cycle.tables(m.spark, folder)
        known = m["entities"].select("id", F.col("id").alias("canonical_name"), "entity_type", F.lit(None).cast("string").alias("organism"), F.lit(0).cast("long").alias("paper_count"))
        t.put(0, "entities", known, list(range(t.buckets)))
        t.put(0, "synonyms", known.select(F.col("id").alias("entity_id"), F.lower("id").alias("synonym")), list(range(t.buckets)))
        t.commit(0)
        none = F.lit(None).cast("string")
        rows = m["evidence"].select("paper_id", "year", "tissue_cell_type", "condition").dropDuplicates(["paper_id"])  # what a paper says of itself
        claims = m["claims"].join(rows, "paper_id").withColumns({"type_a": F.lit("protein"), "type_b": none, "organism": none})
        columns = [c.split()[0] for c in cycle.CLAIMS.split(", ")]
        for n in (1, 2):
            cycle.run_batch(t, claims.where(F.pmod(F.crc32("paper_id"), F.lit(2)) == n - 1).select(*columns), n)
        CYCLED[key] = t
    return CYCLED[key]


CYCLED: dict[tuple[str, str], cycle.Tables] = {}
entry("cycle_interactions", "SELECT entity_a, entity_b, interaction_type, effect, direction, evidence_count, score, label FROM {interactions}")(lambda m: cycled(m).read("interactions").select("entity_a", "entity_b", "interaction_type", "effect", "direction", "evidence_count", "score", "label"))
entry("cycle_conflicts", "SELECT interaction_a, interaction_b FROM {candidates}", **CF)(lambda m: cycled(m).read("conflicts").select("interaction_a", "interaction_b"))
entry("cycle_paper_counts", "SELECT id, CAST(count(DISTINCT paper_id) AS BIGINT) AS paper_count FROM (SELECT entity_a AS id, paper_id FROM {evidence} UNION ALL SELECT entity_b, paper_id FROM {evidence}) q GROUP BY id")(lambda m: cycled(m).read("entities").where("paper_count > 0").select("id", "paper_count"))
