"""What a cycle stores: claims and evidence of a batch, counts, and keyed updates of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.loads import EDGE, interaction_key

ERROR, NOTES, ANALYSIS, CLAIM_SNIPPET = 2000, 500, 5000, 400
SHORTEST_TEXT = 50


def literal_claims(batch: DataFrame) -> DataFrame:
    """A row for every claim of a batch as its text has it, whether or not its evidence is new."""
    named = {"entity_a": "entity_a_text", "entity_b": "entity_b_text", "interaction_type": "interaction_type_text", "direction": "direction_text", "effect": "effect_text", "evidence_type": "evidence_type_text"}
    cut = F.left(F.coalesce("snippet", F.lit("")), F.lit(CLAIM_SNIPPET)).alias("snippet")
    return batch.select(interaction_key("paper_id", "line_no", "entity_a", "entity_b", "interaction_type").alias("claim_id"), "paper_id", "line_no", *[F.col(a).alias(b) for a, b in named.items()], "confidence_score", cut)


def upsert_interactions(batch: DataFrame, interactions: DataFrame) -> DataFrame:
    """The batch's interactions that aren't stored: one for each five columns, a null effect like any other value."""
    new = batch.select(*EDGE).distinct().withColumn("id", interaction_key(*EDGE))
    return new.join(interactions.select(interaction_key(*EDGE).alias("id")), "id", "left_anti")


def paper_counts(batch: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities with paper_count raised by one for each of the batch's papers that names them, however often."""
    ends = batch.select("paper_id", F.explode(F.array("entity_a", "entity_b")).alias("id")).distinct()
    more = ends.groupBy("id").agg(F.count("*").alias("more"))
    return entities.join(more, "id", "left").withColumn("paper_count", F.coalesce("paper_count", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")


def extraction_inputs(papers: DataFrame, full: DataFrame) -> DataFrame:
    """(id, text, full_text_used, error) of papers (id, abstract): the full text (id, full_text) only where it is longer than the abstract.

    A text of under SHORTEST_TEXT characters without its outer blanks isn't extracted: its error says so."""
    abstract, whole = F.coalesce("abstract", F.lit("")), F.coalesce("full_text", F.lit(""))
    longer = F.length(whole) > F.length(abstract)
    rows = papers.join(full.select("id", "full_text"), "id", "left").select("id", F.when(longer, whole).otherwise(abstract).alias("text"), longer.alias("full_text_used"))
    few = F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) < SHORTEST_TEXT
    return rows.withColumn("error", F.when(few, "Insufficient text"))


def route(api: Column, second_enabled: bool = True) -> Column:
    """The crawler of a search: the second literature source by name and if enabled, else the first."""
    return F.when((api == "semantic_scholar") & F.lit(second_enabled), "semantic_scholar").otherwise("pubmed")


def budgets(searches: DataFrame, cycle: str, order: str, available: str, total: int, waiting: DataFrame | None = None) -> DataFrame:
    """(cycle, order, taken): how many papers are extracted after each search of a cycle, in order, of ``total``; and a row without an order
    for the last pass.

    The papers that a search brings join a pool, which starts with those ``waiting`` (cycle, waiting). After each search as many are taken from it
    as the remaining budget divided by the searches left, rounded up, and what isn't taken stays for the next ones. The last
    pass takes what the budget and the pool still have; a cycle without searches has only that. One cycle's searches, whose number is a
    setting, make one row."""
    rows = searches.groupBy(cycle).agg(F.array_sort(F.collect_list(F.struct(order, available))).alias("all"))
    if waiting is not None:
        rows = rows.join(waiting.select(cycle, F.col("waiting").cast("long").alias("pool")), cycle, "full")
    else:
        rows = rows.withColumn("pool", F.lit(0).cast("long"))
    kind = dict(searches.dtypes)[order]
    rows = rows.withColumn("all", F.coalesce("all", F.array().cast(f"array<struct<{order}:{kind},{available}:{dict(searches.dtypes)[available]}>>")))

    def step(acc: Column, x: Column) -> Column:
        pool = acc["pool"] + F.coalesce(x[available].cast("long"), F.lit(0))
        taken = F.least(F.ceil(acc["left"] / acc["n"]), pool)
        return F.struct((acc["left"] - taken).alias("left"), (acc["n"] - 1).alias("n"), (pool - taken).alias("pool"), F.concat(acc["out"], F.array(F.struct(x[order].alias(order), taken.alias("taken")))).alias("out"))

    start = F.struct(F.lit(total).cast("long").alias("left"), F.size("all").cast("long").alias("n"), F.coalesce("pool", F.lit(0)).cast("long").alias("pool"), F.array().cast(f"array<struct<{order}:{kind},taken:bigint>>").alias("out"))
    last = lambda acc: F.concat(acc["out"], F.array(F.struct(F.lit(None).cast(kind).alias(order), F.least(acc["left"], acc["pool"]).alias("taken"))))
    return rows.select(cycle, F.explode(F.aggregate("all", start, step, last)).alias("x")).select(cycle, "x.*")


def update(table: DataFrame, changes: DataFrame, key: str, overwrite: tuple[str, ...] = (), truthy: tuple[str, ...] = (), limits: dict[str, int] | None = None, where: Column | None = None) -> DataFrame:
    """The table with the values of ``changes`` (a row for a key) in its rows of that key that ``where`` allows.

    Columns of ``overwrite`` take the new value, null too; those of ``truthy`` only one that isn't null,
    empty or 0. ``limits`` cuts texts to so many characters. Rows without a change stay."""
    limits = limits or {}
    value = lambda c: F.left(F.col(f"new.{c}"), F.lit(limits[c])) if c in limits else F.col(f"new.{c}")
    some = lambda c: value(c).isNotNull() & ~value(c).cast("string").isin("", "0", "0.0", "false")
    joined = table.alias("old").join(changes.withColumn("_hit", F.lit(True)).alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "left")
    hit = F.coalesce(F.col("new._hit"), F.lit(False)) & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))

    def column(c: str) -> Column:
        old = F.col(f"old.{c}")
        if c in overwrite:
            return F.when(hit, value(c)).otherwise(old).alias(c)
        return F.when(hit & some(c), value(c)).otherwise(old).alias(c) if c in truthy else old

    return joined.select(*[column(c) for c in table.columns])


def transition(searches: DataFrame, changes: DataFrame) -> DataFrame:
    """Searches after ``changes`` (id, status, papers_new, error): running only from pending, done and failed from pending or running.

    A failure keeps the start of its error, null if empty; any other change clears it. A search that is done improved the graph if it has new papers."""
    new, old = F.col("new.status"), F.col("old.status")
    allowed = ((new == "running") & (old == "pending")) | (new.isin("done", "failed") & old.isin("pending", "running"))
    with_facts = changes.withColumn("last_error", F.when(F.col("status") == "failed", F.nullif(F.left(F.coalesce("error", F.lit("")), F.lit(ERROR)), F.lit(""))))
    rows = searches if "last_error" in searches.columns else searches.withColumn("last_error", F.lit(None).cast("string"))
    rows = update(rows.withColumn("before", F.col("status")), with_facts, "id", ("status", "last_error"), where=allowed)
    found = changes.where("status = 'done'").select("id", F.col("papers_new").alias("found"))
    rows = rows.join(found, "id", "left")
    done = (F.col("before") != F.col("status")) & (F.col("status") == "done")
    return rows.withColumns({"papers_new": F.when(done, F.col("found")).otherwise(F.col("papers_new")), "improved": F.when(done, (F.col("found") > 0).cast("int")).otherwise(F.col("improved"))}).drop("found", "before")


def extraction_status(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Papers after ``results`` (id, ok, error): done, or failed with the start of the error."""
    new = results.select("id", F.when(F.col("ok"), "done").otherwise("failed").alias("extraction_status"), F.when(~F.col("ok"), F.col("error")).alias("extraction_error"))
    return update(papers, new, "id", ("extraction_status",), ("extraction_error",), {"extraction_error": ERROR})


def add_ids(conflicts: DataFrame, generated: DataFrame) -> DataFrame:
    """Conflicts with their generated_ids joined by those of ``generated`` (id, query_id), each once."""
    new = generated.groupBy("id").agg(F.collect_set("query_id").alias("more"))
    none = F.array().cast("array<string>")
    joined = conflicts.join(new, "id", "left")
    return joined.withColumn("generated_ids", F.array_sort(F.array_union(F.coalesce("generated_ids", none), F.coalesce("more", none)))).drop("more")


def seed_queries(seeds: DataFrame, searches: DataFrame) -> DataFrame:
    """The seeds (query_text, source_api) that no search has had but for failed ones, if none is pending; else none."""
    waiting = searches.where("status = 'pending'").limit(1).select(F.lit(1).alias("one"))
    idle = seeds.withColumn("one", F.lit(1)).join(F.broadcast(waiting), "one", "left_anti").drop("one")  # one row at most
    had = searches.where("status IN ('pending', 'running', 'done')").select("query_text", "source_api")
    return idle.join(had, ["query_text", "source_api"], "left_anti").dropDuplicates(["query_text", "source_api"])


def telemetry(stats: DataFrame, key: str) -> DataFrame:
    """Counters of phases (key, name, value) summed by name."""
    return stats.groupBy(key, "name").agg(F.sum("value").alias("value"))
