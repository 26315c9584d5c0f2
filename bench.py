"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimweave.plans import catalog
from claimweave.plans.projection import Model
from claimweave.session import local_session

HEADLINE = (
    "confidence_composite", "confidence_top", "entity_search", "degree_by_direction", "top_degree", "synonym_overlaps",
    "evidence_adjudication", "conflict_candidates", "conflicts", "conflict_outcomes", "neighbourhood", "propagate_suppress",
    "propagate_batch", "paths", "propagate_suppress_all", "planning_scores", "targeted_queries", "resolve_exact", "resolve_fuzzy", "source_signed", "curated_load_signor", "reprocess_evidence", "graph_export",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g", int(os.environ.get("BENCH_CPUS", "8")))
    queries = catalog.queries()
    seconds = {}
    spark.read.parquet(f"{folder}/region.parquet").count()
    start = time.perf_counter()
    stored = Model(spark, folder).stored()
    _ = stored["evidence"], stored["synonyms"], stored.interactions  # written once; queries over the graph read them
    seconds["prepare"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
