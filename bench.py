"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully executed (``noop`` sink, no collect) once as a
warm-up and then $BENCH_RUNS times (1 by default); the median is reported, and the shuffle
bytes written by the first timed run are read from Spark's event log (written to
a fresh scratch folder). Prints one JSON line.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "training_raw",            # D07 flagship: users x comments x articles x parents + step index
    "unseen_users",            # D01 NOT IN over the latest comment per user
    "natural_key_lookup",      # D08 natural key -> first id
    "comment_page",            # F04 per-article listing pages
    "normalized_counts",       # H01
    "normalized_times",        # H02
    "insert_first_wins",       # B01
    "resolve_parent_ids",      # W10 + D12
    "next_state_pairs",        # W02
    "evaluation_by_user",      # N01 (W02 + W08 + J03)
    "graph_predictions",       # J07 (D09 + D10 + J01)
    "step_network",            # J05
    "sentiment_vectors",       # T01
    "training_vectorized",     # T03
    "page_fields",             # A03
    "frontier_urls",           # A05
    "stream_ingest_comments",  # S01
    "capped_comments",         # W07
    "carry_article_forward",   # W06
    "train_val_split",         # W08
    "category_vectors",        # T02
    "fit_linear_users",        # M01
    "fit_network_users",       # M02
    "fit_grid",                # M03
]


def shuffle_bytes(event_dir: str, groups: list[str]) -> dict[str, int]:
    """Shuffle bytes written per job group, from the event log."""
    stage_group: dict[int, str] = {}
    written: dict[str, int] = {}
    for path in sorted(p for p in Path(event_dir).rglob("*") if p.is_file()):
        with open(path, errors="replace") as fh:
            for line in fh:
                try:
                    e = json.loads(line)
                except ValueError:
                    continue
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(e.get("Stage ID"))
                    metrics = e.get("Task Metrics") or {}
                    w = (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    if group:
                        written[group] = written.get(group, 0) + int(w)
    return {g: written.get(g, 0) for g in groups}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE

    from forumlens.plans.catalog import load_all
    from forumlens.session import local_session

    events = tempfile.mkdtemp(prefix="forumlens-events-")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2),
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": events,
                                 "spark.eventLog.compress": "false",
                                 "spark.eventLog.rolling.enabled": "false"})
    registry = load_all()
    results: dict[str, float] = {}
    for name in names:
        build = registry[name][0]

        def once(tag: str) -> float:
            spark.sparkContext.setJobGroup(tag, tag)
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once(f"warm:{name}")
        results[name] = round(statistics.median(once(f"run{i}:{name}") for i in range(runs)), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr)
    spark.stop()
    shuffle = shuffle_bytes(events, [f"run0:{n}" for n in names])
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "runs": runs,
        "shuffle_bytes": {n: shuffle.get(f"run0:{n}", 0) for n in names},
    }))


if __name__ == "__main__":
    main()
