"""Benchmark the headline queries.

Runs each query over the ledger tables of ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and writes the result to the
``noop`` sink (all work done, nothing collected).  Each query runs once to
warm up and then ``$BENCH_RUNS`` times (default 3); the best time counts.

Two passes, one JSON line.  ``value`` is the total of the ten queries of
``all_value`` adds the five further headline queries.

* ``queries`` / ``value`` — the tables are derived from the driver Parquet
  did.  Each timed run builds the query (analysis and any eager checkpoint
  included) and executes it; view definitions are shared per session.
* ``stored_queries`` / ``stored_value`` — the production path: the ledger
  tables are stored once with their layout (``fixtures.LAYOUT``, time in
  ``store_seconds``) under the shared checkpoint folder, and the same queries
  read them.  ``BENCH_STORED=0`` skips this pass.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from carrierbook.plans import catalog  # noqa: E402
from carrierbook.session import build_session, scratch_path  # noqa: E402
from carrierbook.sources.fixtures import load_tables, store_tables  # noqa: E402

BASELINE_TEN = ["stock_location", "stock_overall", "stock_location_total", "stock_entrepreneur", "receipt_rollup",
                "partner_history", "case_search", "location_fanout", "notification_prune", "posting"]
# ... first, then further operators.
HEADLINE = [
    "stock_location", "stock_overall", "stock_location_total", "stock_entrepreneur", "receipt_rollup",
    "partner_history", "case_search", "location_fanout", "notification_prune", "posting",
    "case_replay", "permissions_effective", "ledger_receipts", "receipt_page", "notifications_unread",
]


def _time_all(names, make, runs):
    times = {}
    for name in names:
        best = None
        for i in range(runs + 1):
            t0 = time.perf_counter()
            make(name).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", cpus, app_name="carrierbook-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times = _time_all(names, lambda n: catalog.run(spark, sf_dir, n), runs)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    ten = all(n in times for n in BASELINE_TEN)
    out = {"metric": "baseline_ten_total_seconds" if ten else "headline_total_seconds",
           "value": round(sum(times[n] for n in BASELINE_TEN), 3) if ten else round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "all_value": round(sum(times.values()), 3),
           "sf": sf, "cpus": cpus, "runs": runs}
    if os.environ.get("BENCH_STORED", "1") == "1":
        table_dir = scratch_path(spark, f"bench-tables-{os.getpid()}-{int(time.time())}")
        t0 = time.perf_counter()
        store_tables(catalog.ledger_for(spark, sf_dir), table_dir)
        out["store_seconds"] = round(time.perf_counter() - t0, 3)
        ledger = load_tables(spark, table_dir)
        stored = _time_all(names, lambda n: catalog.run_on(ledger, n), runs)
        out.update({"stored_value": round(sum(stored[n] for n in BASELINE_TEN), 3) if ten
                    else round(sum(stored.values()), 3),
                    "stored_all_value": round(sum(stored.values()), 3), "stored_queries": stored})
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
