"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tapewise.plans import QUERIES   # noqa: E402
from tapewise.session import local_session, release_shared   # noqa: E402

HEADLINE = ["K1_dedup_equity", "R3_asof_backward", "R5_period_returns", "S1_formation_signals", "S4_retroactive_persistence",
            "S5_leaderboard_persistence", "B4_summarize_backtest", "B6_random_baseline", "B10_accumulate_backtest",
            "C1_score_from_signals", "C10_candidate_signals", "H1_perp_fills", "H2_round_trips", "H4_gross_exposure",
            "H11_behavior_features", "P1_correlated_pairs", "P6_rebalance_gaps", "P15_tracking_report", "I12_fill_rows",
            "T4_stream_last_hour_equity"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()      # JVM and reader warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        # The whole query runs, rows included; nothing is collected.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        release_shared()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
