"""Command line for the pipeline jobs (``spark-submit`` or ``python -m``).

    python -m depuse.plans.cli build-graph  --records R --out DIR [--direct-only]
    python -m depuse.plans.cli resolve      --logs L --records R --out DIR
    python -m depuse.plans.cli sessionise   --gav-logs DIR --out DIR [--max-idle-ms N]
    python -m depuse.plans.cli dependencies --sessions DIR --graph DIR --out DIR --start T --end T [--depth N]
    python -m depuse.plans.cli report       --enhanced DIR --out DIR --start T --end T [--daily]
    python -m depuse.plans.cli daily-parts  --enhanced DIR --out DIR --start T --end T
    python -m depuse.plans.cli report-days  --parts DIR --out DIR --first DAY --last DAY
    python -m depuse.plans.cli depth-sweep  --sessions DIR --graph DIR --out PREFIX [--depths 1,2]

Times are zoned date-times such as ``2014-06-18T00-00Z``.  Cluster settings
(master, memory, ``spark.checkpoint.dir``) come from spark-submit / defaults.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from depuse.plans import jobs
from depuse.session import build_session, cluster_conf


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="depuse", description="artifact popularity pipeline jobs")
    sub = parser.add_subparsers(dest="job", required=True)
    p = sub.add_parser("build-graph")
    p.add_argument("--records", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--direct-only", action="store_true", help="leave the closure out")
    p = sub.add_parser("resolve")
    p.add_argument("--logs", required=True)
    p.add_argument("--records", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("sessionise")
    p.add_argument("--gav-logs", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--max-idle-ms", type=int, default=jobs.DEFAULT_MAX_IDLE_MS)
    p = sub.add_parser("dependencies")
    for name in ("--sessions", "--graph", "--out", "--start", "--end"):
        p.add_argument(name, required=True)
    p.add_argument("--depth", type=int, default=jobs.D.DEFAULT_DEPTH)
    p = sub.add_parser("report")
    for name in ("--enhanced", "--out", "--start", "--end"):
        p.add_argument(name, required=True)
    p.add_argument("--daily", action="store_true", help="also write per-day reports")
    p = sub.add_parser("daily-parts")
    for name in ("--enhanced", "--out", "--start", "--end"):
        p.add_argument(name, required=True)
    p = sub.add_parser("report-days")
    for name in ("--parts", "--out", "--first", "--last"):
        p.add_argument(name, required=True)
    p = sub.add_parser("depth-sweep")
    for name in ("--sessions", "--graph", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--depths", default="1", help="comma-separated depth settings")
    for name, default in (("--min-size", 2), ("--max-size", 40), ("--step", 1), ("--per-size", 10)):
        p.add_argument(name, type=int, default=default)
    p.add_argument("--new-sample", action="store_true", help="do not reuse tables written before")
    for p in sub.choices.values():
        p.add_argument("--input-bytes", type=int, help="size of the largest shuffle, to choose its partitions")
        p.add_argument("--cores", type=int, default=8, help="executor cores, with --input-bytes")
    return parser


def main(argv: Sequence[str] | None = None, spark=None) -> dict:
    """Run one job; returns a small summary (also printed as JSON)."""
    args = _parser().parse_args(argv)
    conf = cluster_conf(args.input_bytes, args.cores) if args.input_bytes else None
    spark = spark or build_session(f"depuse-{args.job}", conf=conf)
    summary: dict = {"job": args.job}
    if args.job == "build-graph":
        summary.update(jobs.build_graph(spark, args.records, args.out, transitive=not args.direct_only))
    elif args.job == "resolve":
        summary.update(jobs.resolve(spark, args.logs, args.records, args.out))
    elif args.job == "sessionise":
        jobs.sessionise(spark, args.gav_logs, args.out, max_idle_ms=args.max_idle_ms)
    elif args.job == "dependencies":
        jobs.compute_dependencies(spark, args.sessions, args.graph, args.out, args.start, args.end, depth=args.depth)
    elif args.job == "report":
        summary["reports"] = list(jobs.report(spark, args.enhanced, args.out, args.start, args.end))
        if args.daily:
            summary["daily"] = list(jobs.daily_report(spark, args.enhanced, args.out, args.start, args.end))
    elif args.job == "daily-parts":
        jobs.daily_parts(spark, args.enhanced, args.out, args.start, args.end)
    elif args.job == "report-days":
        summary["reports"] = list(jobs.report_days(spark, args.parts, args.out, args.first, args.last))
    elif args.job == "depth-sweep":
        depths = [int(d) for d in args.depths.split(",") if d.strip()]
        grid = (args.min_size, args.max_size, args.step, args.per_size)
        jobs.depth_sweep(
            spark, args.sessions, args.graph, args.out, depths=depths, grid=grid, reuse_sample=not args.new_sample
        )
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
