"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout.

A query's time covers building, planning and running it to the last row (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "panel_daily",
    "factor_reversal_5",
    "factor_volatility_60",
    "factor_price_volume_corr_20",
    "factor_ivol_60",
    "universe_mask",
    "preprocess_factor",
    "rank_ic",
    "quantile_returns",
    "factor_correlation",
    "hac_mean",
    "index_membership",
    "asof_factor",
    "merge_sources",
    "gap_islands",
    "price_chain",
    "audit_panel",
    "top_n_weights",
    "buffered_top_n",
    "estimate_orders",
    "portfolio_returns",
    "audit_ledger",
    "ridge_walk_forward",
    "walk_forward_folds",
    "suite_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    from lattica.catalog import QUERIES
    from lattica.session import local_session

    spark = local_session(cores, "lattica-bench", os.environ.get("BENCH_MEMORY", "12g"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1],
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
