"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully into Spark's ``noop`` sink (all rows computed,
nothing collected to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motorsight.plans.registry import load_all  # noqa: E402
from motorsight.session import get_spark  # noqa: E402

HEADLINE = [
    "fleet_risk", "physics_features", "risk_scales", "ordered_feature_set", "rolling_stats",
    "ema_spans", "time_to_failure", "seven_day_window", "roc_auc", "ks_drift",
    "threshold_sweep", "alarm_labels", "plant_assembly", "diagnostic_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "4g")})
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    names = only or [n for n in HEADLINE if n in reg]
    times: dict[str, float] = {}
    # Warm-up: JVM code paths and the Python workers, not timed.
    reg["fleet_risk"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.time()
        reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
