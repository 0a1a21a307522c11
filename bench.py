"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads,
BENCH_QUERIES (optional) a comma-separated choice of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from planeweave.plans import catalog  # noqa: E402
from planeweave.session import local_session  # noqa: E402

HEADLINE = [
    "n2_flow_assignment", "n5_payload_visibility", "n8_procedure_union", "k1_latency",
    "k3_cross_plane_latency", "k5_next_terminal_gap", "p2_request_response_pairing",
    "p8_retransmit_flag", "b6_refusal_propagation", "b9_request_response_pairing",
    "c4_sbi_response_inheritance", "c5_n4_link", "i7_incident_union", "e5_grounding",
    "m2_consolidate", "m4_similar_episodes", "t1_sctp_retransmission_dedup",
    "t2_chunk_reassembly", "x5_chunk_emit", "x13_co_mentioned_edges", "r1_cosine_similarity",
    "r2_phrase_bonus", "r3_hybrid_top_k", "r5_hybrid_answer", "v1_type_accuracy", "w3_plane_timelines",
    "w7_report_assembly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    # One pass over a small table starts the executors before timing begins.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
