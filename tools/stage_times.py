"""Stage and task times of one registered query, from Spark's event log.

Runs the query with the event log written to a fresh scratch folder (no UI,
no server) and prints, per stage: tasks, wall time, median and max task time,
and shuffle bytes read / written.  A max task time far above the median is
the sign of a skewed (hot) key.

Usage: python tools/stage_times.py <query> [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carrierbook.plans import catalog  # noqa: E402
from carrierbook.session import build_session  # noqa: E402


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="carrierbook-eventlog-")
    spark = build_session("local[8]", 8, app_name="carrierbook-stages",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false"})
    catalog.run(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
    spark.stop()
    stages, tasks = {}, {}
    # Spark writes one folder of rolling event files per application.
    for path in sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)):
        if path.endswith(".inprogress") or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    stages[info["Stage ID"]] = info
                elif kind == "SparkListenerTaskEnd":
                    sid = ev["Stage ID"]
                    t = ev["Task Info"]
                    m = ev.get("Task Metrics") or {}
                    sr = (m.get("Shuffle Read Metrics") or {})
                    sw = (m.get("Shuffle Write Metrics") or {})
                    tasks.setdefault(sid, []).append((
                        t["Finish Time"] - t["Launch Time"],
                        sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0),
                        sw.get("Shuffle Bytes Written", 0)))
    print(f"{name} on {sf_dir}")
    print(f"{'stage':>5} {'tasks':>5} {'wall ms':>8} {'median ms':>9} {'max ms':>7} {'shuffle read':>12} {'shuffle write':>13}  name")
    for sid in sorted(stages):
        info = stages[sid]
        ts = tasks.get(sid, [])
        durs = [d for d, _, _ in ts] or [0]
        wall = (info.get("Completion Time") or 0) - (info.get("Submission Time") or 0)
        print(f"{sid:>5} {len(ts):>5} {wall:>8} {int(statistics.median(durs)):>9} {max(durs):>7} "
              f"{sum(r for _, r, _ in ts):>12} {sum(w for _, _, w in ts):>13}  {info.get('Stage Name', '')[:60]}")


if __name__ == "__main__":
    main()
