"""End-to-end jobs: each reads its inputs, runs the operators, writes tables.

    build_graph          records text  -> graph files (direct and closure) + closure parquet
    resolve              logs text + records text -> gav logs parquet
    sessionise           gav logs parquet -> sessions parquet
    compute_dependencies sessions parquet (range) + graph -> enhanced sessions parquet
    report               enhanced sessions parquet (range) -> two CSV reports
    daily_parts          enhanced sessions parquet (range) -> client sets per day
    report_days          client sets per day -> two CSV reports of any days
    depth_sweep          sessions parquet -> sample, histogram, per-depth results

Intermediate tables are written between stages (as the pipeline is meant to
run: each stage is restartable from the previous stage's output).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from depuse import schemas
from depuse.functions.parsing import LOG_LINE_PATTERN, RECORD_LINE_PATTERN, is_well_formed
from depuse.functions.time import MILLIS_PER_DAY, bound_name, parse_bound
from depuse.operators import daily as U
from depuse.operators import deps as D
from depuse.operators import graph as G
from depuse.operators import profile as P
from depuse.operators import report as R
from depuse.operators import sessions as S
from depuse.operators.resolve import resolve_gavs
from depuse.sources.manifest import reuse_or_build
from depuse.sources.tables import read_table, write_table
from depuse.sources.text import (
    parse_dependency_records,
    parse_repository_logs,
    read_dependency_records,
    read_graph,
)

# The pipeline defaults.
DEFAULT_MAX_IDLE_MS = 60_000


def build_graph(
    spark: SparkSession,
    records_path: str,
    out_dir: str,
    transitive: bool = True,
    salt: bool = True,
) -> dict[str, int]:
    """Records text -> ``nodes`` and ``edges`` graph files under ``out_dir``.

    The edge files always hold the direct edges (type ``D_DEPENDS_ON``).  With
    ``transitive`` they hold the exact closure too (type ``T_DEPENDS_ON``), and
    it is kept as parquet (``closure``) for the depth-1 dependency computation.
    Returns the numbers of nodes, direct edges, closure pairs and rejected lines.
    """
    lines, rejects = _with_rejects(spark.read.text(records_path), RECORD_LINE_PATTERN)
    records = parse_dependency_records(lines)
    nodes, edges = G.build_graph(records)
    nodes = G.materialise(nodes)
    edges = G.materialise(edges)
    out = out_dir.rstrip("/")
    closure = None
    if transitive:
        # sorted before the targets are listed: one row a source
        reach = G.transitive_closure(edges, salt=salt, packed=True).sortWithinPartitions("src")
        write_table(G.unpacked(reach), f"{out}/closure")
        closure = read_table(spark, f"{out}/closure")
    G.write_graph(nodes, edges, f"{out}/nodes", f"{out}/edges", closure)
    stats = G.graph_stats(nodes, edges).collect()[0]
    return {
        "nodes": stats["nodes"], "edges": stats["edges"], "closure": closure.count() if transitive else 0,
        "rejected": int(rejects.get["rejected"] or 0),
    }


def _with_rejects(lines: DataFrame, pattern: str) -> tuple[DataFrame, Observation]:
    """Lines, and a count of the malformed ones taken while they are read."""
    seen = Observation()
    return lines.observe(seen, F.count_if(~is_well_formed(F.col("value"), pattern)).alias("rejected")), seen


def resolve(
    spark: SparkSession,
    logs_path: str,
    records_path: str,
    gav_logs_path: str,
    salt: bool = True,
) -> dict[str, int]:
    """Logs + records text -> gav logs parquet, clustered by (client, time).

    Downloads of one path can be a large share of all, so hot paths are salted.
    The raw logs are read once: the parsed columns are materialised for the
    several passes that follow (hot paths, the join, the range sampling), and
    the rejected lines, whose number is returned, are counted on the way.
    """
    lines, rejects = _with_rejects(spark.read.text(logs_path), LOG_LINE_PATTERN)
    logs = G.materialise(parse_repository_logs(lines))
    records = read_dependency_records(spark, records_path, require_unique_path=True)
    write_table(resolve_gavs(logs, records, sort=True, salt=salt), gav_logs_path)
    return {"rejected": int(rejects.get["rejected"] or 0)}


def sessionise(
    spark: SparkSession,
    gav_logs_path: str,
    sessions_path: str,
    max_idle_ms: int = DEFAULT_MAX_IDLE_MS,
    partition_by_day: bool = True,
) -> None:
    """Gav logs parquet -> sessions parquet.

    Partitioned by the UTC day of the session start (``startDay``) so date
    ranges read only their days' folders, and sorted by start time within
    files so range filters also skip row groups.
    """
    gav_logs = read_table(spark, gav_logs_path)
    schemas.check_columns(gav_logs, schemas.GAV_LOG, "gav logs")
    sessions = S.create_sessions(gav_logs, max_idle_ms)
    if partition_by_day:
        # range partitions: each task holds a balanced, contiguous time range,
        # so it writes files for the one or two days it spans (a hash on the
        # day would put a whole day in one task)
        sessions = S.with_start_day(sessions).repartitionByRange("startTime", "clientId")
        write_table(sessions, sessions_path, partition_by=[S.DAY_COLUMN], cluster_by=["startTime"])
    else:
        write_table(sessions, sessions_path, cluster_by=["startTime"])


def compute_dependencies(
    spark: SparkSession,
    sessions_path: str,
    graph_dir: str,
    enhanced_path: str,
    start: str | int,
    end: str | int,
    depth: int = D.DEFAULT_DEPTH,
) -> None:
    """Sessions starting in ``[start, end)`` -> enhanced sessions parquet.

    Depth 1 reads the closure kept by ``build_graph``; the other depths follow
    its direct edges.
    """
    sessions = S.between(read_table(spark, sessions_path), parse_bound(start), parse_bound(end))
    schemas.check_columns(sessions, schemas.SESSION, "sessions")
    graph = graph_dir.rstrip("/")
    closure = _closure(spark, graph) if depth == 1 else None
    edges = None
    if closure is None:
        _, edges = read_graph(spark, f"{graph}/nodes", f"{graph}/edges")
    enhanced = D.compute_dependencies(sessions, edges, depth=depth, closure=closure, materialise_input=False)
    if S.DAY_COLUMN in enhanced.columns:
        enhanced = enhanced.repartitionByRange("startTime", "clientId")
        write_table(enhanced, enhanced_path, partition_by=[S.DAY_COLUMN], cluster_by=["startTime"])
    else:
        write_table(enhanced, enhanced_path, cluster_by=["startTime"])


def _closure(spark: SparkSession, graph: str) -> DataFrame:
    try:
        return read_table(spark, f"{graph}/closure")
    except AnalysisException as err:
        raise ValueError(f"{graph} was built without its closure: depth 1 needs build_graph(transitive=True)") from err


def report(
    spark: SparkSession,
    enhanced_path: str,
    report_dir: str,
    start: str,
    end: str,
) -> tuple[str, str]:
    """Enhanced sessions starting in ``[start, end)`` -> the two CSV reports."""
    enhanced = S.between(read_table(spark, enhanced_path), parse_bound(start), parse_bound(end))
    schemas.check_columns(enhanced, schemas.ENHANCED_SESSION, "enhanced sessions")
    return R.write_report(enhanced, report_dir, start, end)


def daily_report(
    spark: SparkSession,
    enhanced_path: str,
    report_dir: str,
    start: str,
    end: str,
) -> tuple[str, str]:
    """Enhanced sessions starting in ``[start, end)`` -> per-day direct and
    indirect usage tables (CSV partitioned by day)."""
    enhanced = S.between(read_table(spark, enhanced_path), parse_bound(start), parse_bound(end))
    schemas.check_columns(enhanced, schemas.ENHANCED_SESSION, "enhanced sessions")
    return R.write_daily_reports(enhanced, report_dir.rstrip("/") + f"/{bound_name(start)}_{bound_name(end)}_daily")


def daily_parts(spark: SparkSession, enhanced_path: str, parts_path: str, start: str | int, end: str | int) -> None:
    """Enhanced sessions starting in ``[start, end)`` -> client sets per day.

    The bounds are whole UTC days.  Days of the range that have sessions replace
    their folders; all other days stay, so each day is added or redone alone.
    """
    first, last = parse_bound(start), parse_bound(end)
    if first % MILLIS_PER_DAY or last % MILLIS_PER_DAY:
        raise ValueError("daily parts are built for whole UTC days")
    enhanced = S.between(read_table(spark, enhanced_path), first, last)
    schemas.check_columns(enhanced, schemas.ENHANCED_SESSION, "enhanced sessions")
    parts = U.daily_parts(enhanced).repartitionByRange(U.DAY, "gav", "block").sortWithinPartitions(U.DAY, "gav")
    writer = parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(U.DAY).parquet(parts_path)


def report_days(spark: SparkSession, parts_path: str, report_dir: str, first_day: str, last_day: str) -> tuple[str, str]:
    """The two CSV reports over the days ``first_day`` to ``last_day`` (UTC
    dates, both included) from client sets per day; sessions are not read."""
    usage = G.materialise(U.usage_of_days(read_table(spark, parts_path), first_day, last_day))
    direct, indirect = (usage.filter(F.col("kind") == kind).select("gav", "clients") for kind in ("direct", "indirect"))
    return R.write_usage(direct, indirect, report_dir, first_day, last_day)


def depth_sweep(
    spark: SparkSession,
    sessions_path: str,
    graph_dir: str,
    out_prefix: str,
    depths: Sequence[int] = (1,),
    grid: tuple[int, int, int, int] = (P.DEFAULT_MIN_SIZE, P.DEFAULT_MAX_SIZE, P.DEFAULT_STEP, P.DEFAULT_PER_SIZE),
    reuse_sample: bool = True,
) -> DataFrame:
    """Stratified session sample -> per-depth dependency counts.

    The sample (``<prefix>-sample-<grid>``) and the size histogram
    (``<prefix>-histogram``) are managed tables (``sources.manifest``): reused
    while the sessions' files and the grid are the same, both built anew with
    ``reuse_sample=False``.  Results go to ``<prefix>-results-<grid>``.
    """
    lo, hi, step, n = grid
    tag = f"{lo}-{hi}-{step}-{n}"
    sessions = read_table(spark, sessions_path)

    def kept(name: str, create, **parameters) -> DataFrame:
        return reuse_or_build(spark, f"{out_prefix}-{name}", create, parameters, [sessions_path], rebuild=not reuse_sample)

    sample = kept(
        f"sample-{tag}", lambda: P.sample_by_size(sessions, lo, hi, step, n), min_size=lo, max_size=hi, step=step, per_size=n
    )
    kept("histogram", lambda: P.session_size_histogram(sessions))
    _, edges = read_graph(spark, f"{graph_dir.rstrip('/')}/nodes", f"{graph_dir.rstrip('/')}/edges")
    results = P.depth_sweep(sample, edges, depths)
    write_table(results, f"{out_prefix}-results-{tag}")
    return read_table(spark, f"{out_prefix}-results-{tag}")
