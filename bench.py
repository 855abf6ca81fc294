"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

All queries run ``WARM`` times first, so that the JVM has compiled what they need; then each
runs ``RUNS`` times, its result materialised without being collected.  The best time counts,
and ``value`` is the sum over the headline queries.
"""

from __future__ import annotations

import json
import os
import time

RUNS, WARM = 3, 4
HEADLINE = ("tpch_q1", "tpch_q6", "tpch_q3", "tpch_q12_shaped")
OTHERS = ("s1_scan_count", "r5_five_way", "a3_count_distinct_grouped", "r14_distinct", "r17_topk", "d7_composite_key", "r8_group_date")


def main() -> None:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tarnql import queries
    from tarnql.session import session

    settings = {
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    spark = session(**settings)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for _ in range(WARM):
        for name in HEADLINE + OTHERS:
            run(name)
    took = {name: round(min(run(name) for _ in range(RUNS)), 4) for name in HEADLINE + OTHERS}
    value = round(sum(took[n] for n in HEADLINE), 4)
    print(json.dumps({"metric": "headline queries, best of 3", "value": value, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
