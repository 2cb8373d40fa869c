"""Time every query at one scale and print one JSON line.

``BENCH_SF_DIR`` is the folder of tables, ``BENCH_CPUS`` the number of threads.
Building a query is timed too, since some measure their keys first. An ordered
query is timed once more, beside the total, with a depth at which its keys are
cut, since at these scales none are by default.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewheel import plans
from tidewheel.operators.segments import DEPTH_CONF
from tidewheel.session import build_session

#: An ordered query on large keys, and a depth in rows that cuts its keys at sf0.1.
CUT = ["orders_ranked_by_priority"]
CUT_ROWS = "20000"


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        extra={
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("hourly_events")  # starts the JVM's and the scheduler's first-use work
    seconds = {name: run(name) for name in sys.argv[1:] or plans.QUERIES}
    spark.conf.set(DEPTH_CONF, CUT_ROWS)
    cut = {name: run(name) for name in CUT if name in seconds}
    print(
        json.dumps(
            {
                "metric": "all_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "with_keys_cut": cut,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
