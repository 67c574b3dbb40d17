"""Headline queries, timed over everything they compute; prints one JSON line.

BENCH_SF_DIR: folder of the tables.  BENCH_CPUS: cores.  BENCH_ONLY: comma-separated names.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tickloom.catalog import QUERIES
from tickloom.session import local_session

HEADLINES = [
    "golden_cross_backtest",    # bars -> one rule -> result row per symbol
    "sma",                      # plain frames
    "adx",                      # chained recursive smoothing
    "macd",
    "equity_curve",             # position, fills and equity per bar
    "trade_pairing",
    "results_table",            # all rules, all metrics
    "parameter_sweep",
    "walk_forward_selection",
    "permutation_test",         # 1,000 orders
    "bootstrap_interval",       # 1,000 series of blocks
    "path_metrics",
    "rolling_max_drawdown",
    "var_cvar",
    "correlation_matrix",
    "feature_table",
    "source_fallback",
    "stream_ohlcv_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_ONLY", ",".join(HEADLINES)).split(",")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1_000_000).selectExpr("sum(id)").collect()      # start the executors
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
