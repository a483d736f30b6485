"""Times the headline queries and prints one JSON line.

Results are written to Spark's ``noop`` sink, so every output column of every row is
computed and nothing is collected. One untimed pass warms the JVM.
"""

from __future__ import annotations

import json
import os
import time

from tickerloom.plans import all_queries
from tickerloom.plans.domain import Domain
from tickerloom.plans.registry import CASES
from tickerloom.session import local_session

HEADLINE = (
    "T02_sma", "T03_ema", "T04_rolling_std", "T14_full_suite", "T15_rolling_beta",
    "T20_incremental_indicators", "B08_ttm_ratios", "V01_ratios_ttm", "V09_model_dataset",
    "J05_as_of_backward", "A07_percentiles", "K03_ranked_top", "K06_portfolio_performance",
    "R03_yearly_bands", "E03_horizon_metrics", "Q08_price_spikes", "S10_replace_range",
    "W12_latest_row", "M02_chronological_split", "M03_minmax_scaled", "M05_k_best_signed", "V06_ratio_refresh",
    "Q15_severity_counts", "T16_beta_table", "T20_state_advance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    all_queries.load()
    spark = local_session(cpus)
    domain = Domain(spark, sf_dir)

    def once(name: str) -> float:
        start = time.perf_counter()
        CASES[name].build(domain).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("T02_sma")
    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(once(name), 3)
    suite_rows = domain.bars.count()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
        "suite_values_per_sec": round(suite_rows * 44 / seconds["T14_full_suite"]),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
