"""Measure task balance under a hot client, from Spark's event log.

A third of the downloads of the benchmark logs is moved to one client (every
event whose id is a multiple of 3), then sessions are built two ways: by this
package (bucketed) and by the classic per-client window over raw rows.  For
each run the stage with the most unbalanced shuffle read is reported: its
largest task's share of the stage's records.  Writes docs/SKEW.md.

Usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from depuse.operators import deps as D  # noqa: E402
from depuse.operators import graph as G  # noqa: E402
from depuse.operators import sessions as S  # noqa: E402
from depuse.operators.resolve import resolve_gavs  # noqa: E402
from depuse.plans import catalog  # noqa: E402
from depuse.session import build_session  # noqa: E402
from depuse.sources import driver  # noqa: E402

MAX_IDLE = catalog.MAX_IDLE_MS


def classic_sessions(gav_logs):
    w = Window.partitionBy("clientId").orderBy("timestamp")
    flagged = gav_logs.withColumn(
        "isNew", F.when(F.col("timestamp") - F.lag("timestamp").over(w) > MAX_IDLE, 1).otherwise(0)
    ).withColumn("sessionId", F.sum("isNew").over(w))
    return flagged.groupBy("clientId", "sessionId").agg(
        F.min("timestamp").alias("startTime"), F.max("timestamp").alias("endTime"), F.collect_set("gav").alias("gavs")
    )


def stage_balance(log_dir, job_group):
    """(largest task / mean task, records) of the most unbalanced
    shuffle-reading stage of the job group (1.0 = perfectly even)."""
    path = glob.glob(f"{log_dir}/*")[0]
    files = sorted(glob.glob(f"{path}/events_*")) if os.path.isdir(path) else [path]
    stage_jobs, tasks = {}, {}
    for f in files:
        for line in open(f):
            e = json.loads(line)
            ev = e["Event"]
            if ev == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stage_jobs[sid] = group
            elif ev == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                tasks.setdefault(e["Stage ID"], []).append(read)
    worst = (0.0, 0)
    for sid, reads in tasks.items():
        total = sum(reads)
        if stage_jobs.get(sid) != job_group or total < 10000:
            continue
        worst = max(worst, (max(reads) / (total / len(reads)), total))
    return worst


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="depuse-skew-")
    spark = build_session(
        "depuse-skew", master="local[8]", shuffle_partitions=32,
        conf={"spark.driver.memory": "12g",
              "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
              "spark.sql.adaptive.coalescePartitions.enabled": "false",
              # at this size AQE would broadcast the joins away; turned off to stand in
              # for inputs beyond the broadcast threshold
              "spark.sql.autoBroadcastJoinThreshold": "-1"},
    )
    logs = driver.repository_logs(spark, sf, with_event_id=True)
    hot = logs.withColumn("clientId", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("clientId")))
    gav_logs = G.materialise(resolve_gavs(hot.drop("event_id"), driver.dependency_records(spark, sf)))
    total = gav_logs.count()
    hot_rows = gav_logs.filter(F.col("clientId") == 1).count()
    flags_input = G.materialise(
        resolve_gavs(hot, driver.dependency_records(spark, sf), keep=("event_id",))
    )
    runs = {
        "bucketed sessions (this package)": lambda: S.create_sessions(gav_logs, MAX_IDLE),
        "classic per-client window": lambda: classic_sessions(gav_logs),
        "per-download session flags (event-id tiebreak)": lambda: S.flag_sessions(
            flags_input, MAX_IDLE, tiebreak=("event_id",)),
    }
    results = {}
    for name, build in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        out = build()
        out.write.format("noop").mode("overwrite").save()
        results[name] = (time.perf_counter() - t0, out)
    spark.sparkContext.setJobGroup("setup", "setup")
    sess = G.materialise(S.create_sessions(gav_logs, MAX_IDLE))
    spark.sparkContext.setJobGroup("deps", "deps")
    D.compute_dependencies(sess, catalog.edges(spark, sf), depth=40).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("setup", "setup")
    # a hot gav: a third of the downloads hit one path
    hot_path = logs.withColumn(
        "path", F.when(F.col("event_id") % 3 == 1, F.lit("artifacts/97.pom")).otherwise(F.col("path"))
    )
    records = driver.dependency_records(spark, sf)
    for salt in (True, False):
        name = f"gav resolution, hot path, salt={salt}"
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        resolve_gavs(hot_path.drop("event_id"), records, salt=salt).write.format("noop").mode("overwrite").save()
        results[name] = (time.perf_counter() - t0, None)
    # the default path at scale: AQE splits the hot partition once it passes its
    # size thresholds; scaled down here to this data size
    name = "gav resolution, hot path, salt=False, AQE skew thresholds scaled to the data"
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "65536")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "65536")
    spark.sparkContext.setJobGroup(name, name)
    t0 = time.perf_counter()
    resolve_gavs(hot_path.drop("event_id"), records).write.format("noop").mode("overwrite").save()
    results[name] = (time.perf_counter() - t0, None)
    spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.sparkContext.setJobGroup("setup", "setup")
    hot_logs = G.materialise(resolve_gavs(hot_path.drop("event_id"), records))
    hot_sessions = G.materialise(S.create_sessions(hot_logs, MAX_IDLE))
    long = G.materialise(S.session_gavs(hot_sessions))
    hot_gav_rows = long.filter(F.col("gav") == "org.part:p97").count()
    long_rows = long.count()
    reach = G.materialise(G.reachable(catalog.edges(spark, sf)).select("src", "dst"))
    for salt in (True, False):
        name = f"session dependencies, hot gav, salt={salt}"
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        D.session_dependencies(long, reach, salt=salt).write.format("noop").mode("overwrite").save()
        results[name] = (time.perf_counter() - t0, None)
    # hot intermediate nodes: in late closure rounds most sources reach the
    # same few low-numbered parts, the BFS step's join key
    for salt in (True, False):
        name = f"full closure, salt={salt}"
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        G.reachable(catalog.edges(spark, sf), salt=salt).write.format("noop").mode("overwrite").save()
        results[name] = (time.perf_counter() - t0, None)
    spark.sparkContext.setJobGroup("compare", "compare")
    same = (
        results["bucketed sessions (this package)"][1].select("clientId", "startTime", "endTime")
        .exceptAll(results["classic per-client window"][1].select("clientId", "startTime", "endTime")).count() == 0
    )
    spark.sparkContext.setJobGroup("done", "done")
    spark.stop()
    lines = [
        "# Task balance under a hot client", "",
        f"Generated by `tools/skew_check.py` on `{sf}`: {hot_rows:,} of {total:,} resolved downloads "
        f"({hot_rows / total:.0%}) moved to client 1; 32 shuffle partitions, partition coalescing and broadcast "
        "joins off (standing in for inputs beyond the broadcast threshold). "
        "For each run: the most unbalanced shuffle-reading stage (at least 10,000 records), as its largest task's "
        "records over the mean task's (1.0 = even; 32 = everything in one task).", "",
        "| run | largest / mean task | records in that stage | seconds |", "| --- | --- | --- | --- |",
    ]
    share, recs = stage_balance(log_dir, "deps")
    for name, (secs, _) in results.items():
        s_share, s_recs = stage_balance(log_dir, name)
        lines.append(f"| {name} | {s_share:.1f} | {s_recs:,} | {secs:.1f} |")
        if name.startswith("classic"):
            lines.append(f"| session dependencies (depth 40) on the bucketed sessions | {share:.1f} | {recs:,} | |")
    lines += ["", f"Both session methods give the same sessions: {same}.",
              f"Hot-path case: a third of the downloads hit `artifacts/97.pom`; resolution (J1) is run plain "
              "(the default, relying on AQE's skew split, which needs partitions above 256 MB) and salted. "
              f"`org.part:p97` is then in {hot_gav_rows:,} of {long_rows:,} session-gav rows; their join with the "
              "full closure (J2) is run salted (the default) and plain.",
              "AQE splits a skewed partition along map-task boundaries; this input yields only a few map tasks, so "
              "even with its thresholds scaled down AQE cannot split the hot path here. With thousands of map tasks "
              "at scale it can, and `salt=True` splits independently of the map-task count.", ""]
    out_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "SKEW.md")
    with open(out_path, "w") as fh:
        fh.write("\n".join(lines))
    print("\n".join(lines))


if __name__ == "__main__":
    main()
