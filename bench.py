"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sessionloom.catalog import load
from sessionloom.session import local_session

HEADLINE = (
    "E01_resample_bars", "F01_continuity_segments", "F02_episodes", "E04_market_context", "F03_swing_points", "D10_first_close_beyond",
    "F12_gap_zones", "D13_zone_lifecycle", "F13_mitigation_events", "D16_zone_overlap_pairs", "D08_bar_level_interactions",
    "F10_breakout_signals", "D17_exit_barrier_grid", "F11_session_trade_limit", "E14_sweep_metrics", "E09_trade_summary",
    "F06_rolling_expectancy", "F07_max_drawdown", "F08_max_losing_streak", "F05_ordinal_bins", "J02_market_structure",
    "J05_internal_levels", "J06_range_tracking", "J07_block_discovery", "N01_stream_bars",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries, _ = load()
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
