"""Time the headline queries; prints one JSON line.

Every query runs once to warm up and once to be timed, writing its whole result
to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.registry import QUERIES  # noqa: E402
from watchkeep.session import session  # noqa: E402

HEADLINE = [
    "read_logs", "filter_language", "logs_keyword", "log_search_all", "export_logs", "live_logs",
    "log_stats", "top_attackers", "mitre_coverage", "dashboard_stats", "severity_timeline", "eps_history",
    "ip_reputation", "alerts_with_logs", "tactic_counts",
    "rule_brute_force", "rule_port_scan", "rule_privilege_escalation", "rule_powershell", "rule_beaconing",
    "alert_records", "all_alerts", "ueba_profiles", "ueba_top_users", "anomaly_scores",
    "alerts_acknowledged", "escalated_incidents", "incidents_updated", "incident_transitions", "stream_eps",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
        "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
