"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line {"metric", "value", "unit", "queries", "total", "sf"}.
The value is the full pass (logs -> sessions -> closure -> dependencies ->
every headline query's median and "total" their sum.  Each query runs its
whole plan into the no-op sink, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from depuse.operators import deps, graph, report  # noqa: E402
from depuse.plans import catalog  # noqa: E402
from depuse.session import build_session, ensure_checkpoint_dir  # noqa: E402

HEADLINE = (
    "direct_usage",
    "indirect_usage",
    "sessions",
    "session_flags",
    "resolve_gavs",
    "transitive_closure",
    "session_dependencies_closure",
    "enhanced_sessions",
    "depth_sweep",
    "traversal_work",
    "order_direct_usage",
    "full_pass",
)
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
# Repeats stop once this much time has gone; every query is timed once at least.
BUDGET_S = float(os.environ.get("BENCH_BUDGET_S", "420"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_pass(spark, sf_dir: str) -> None:
    """Logs -> sessions -> full closure -> dependencies (depth 1) -> both
    reports, with the enhanced sessions materialised once and read by both."""
    closure = graph.transitive_closure(catalog.edges(spark, sf_dir))
    enhanced = graph.materialise(
        deps.compute_dependencies(catalog.report_sessions(spark, sf_dir), None, depth=1, closure=closure)
    )
    run(report.direct_usage(enhanced))
    run(report.indirect_usage(enhanced))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(HEADLINE)
    memory = os.environ.get("BENCH_DRIVER_MEMORY", "12g")
    spark = build_session(
        "depuse-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        conf={"spark.driver.memory": memory},
    )
    ensure_checkpoint_dir(spark)
    # warm the JVM (class loading, code generation) on the smallest tables,
    # outside the timings
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        run(catalog.flagship(spark, warm))
    run(catalog.QUERIES["graph_stats"](spark, sf_dir))
    timings: dict[str, list[float]] = {}
    small: dict[str, float] = {}
    began = time.perf_counter()

    def timed(name: str, folder: str) -> float:
        t0 = time.perf_counter()
        if name == "full_pass":
            full_pass(spark, folder)
        else:
            run(catalog.QUERIES[name](spark, folder))
        return time.perf_counter() - t0

    match = re.search(r"sf([0-9.]+)$", sf_dir)
    tenth = os.path.join(os.path.dirname(sf_dir), "sf0.01") if match and match[1] == "0.1" else None
    for turn in range(max(1, REPEATS)):
        for name in names:
            if not turn or time.perf_counter() - began < BUDGET_S:
                timings.setdefault(name, []).append(timed(name, sf_dir))
        if not turn and tenth and os.path.isdir(tenth):
            small = {name: timed(name, tenth) for name in names if time.perf_counter() - began < BUDGET_S}
    medians = {name: round(statistics.median(t), 3) for name, t in timings.items()}
    # records (logs -> sessions -> closure -> dependencies -> both reports);
    # every query's own median and their sum are reported too, and how much
    # longer each takes than on a tenth of the data
    headline = "full_pass" if "full_pass" in medians else None
    print(json.dumps({
        "metric": "full_pass_sec" if headline else "headline_total",
        "value": medians[headline] if headline else round(sum(medians.values()), 3),
        "unit": "sec",
        "queries": medians,
        "runs": {name: len(t) for name, t in timings.items()},
        "sf0.01": {name: round(t, 3) for name, t in small.items()},
        "ratio_to_sf0.01": {name: round(medians[name] / t, 2) for name, t in small.items()},
        "total": round(sum(medians.values()), 3),
        "sf": float(match.group(1)) if match else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
