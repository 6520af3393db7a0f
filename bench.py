"""Headline queries on the driver's tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from citegraph.plans import all_queries
from citegraph.session import build_session

HEADLINE = (
    "B1_resolve_identity",
    "B1_resolve_identity_by_line",
    "C1_merge_assertions",
    "C10_stats",
    "D2_edge_assertions",
    "D6_neighborhood_ranked",
    "D9_field_canon",
    "E1_record_artifact",
    "F6_detect_folios",
    "F8_folio_runs",
    "F11_chunk_pages",
    "G7_links",
    "H1_diff",
    "H6_notes_diff",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries().queries
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
