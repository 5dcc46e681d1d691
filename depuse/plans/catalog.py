"""Named queries over the benchmark tables (``queries()`` of the entry module).

Every query reads the driver tables through ``sources.driver`` and runs the
library operators over all of their rows.  Arrays are rendered as sorted,
comma-joined text plus a count so results compare independent of order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depuse.functions.arrays import sorted_text
from depuse.functions.time import bound_millis, parse_bound
from depuse.operators import daily as U
from depuse.operators import deps as D
from depuse.operators import graph as G
from depuse.operators import profile as P
from depuse.operators import quality as Q
from depuse.operators import report as R
from depuse.operators import sessions as S
from depuse.operators.resolve import resolve_gavs
from depuse.plans import jobs
from depuse.session import ensure_checkpoint_dir
from depuse.sources import driver
from depuse.sources.manifest import reuse_or_build
from depuse.sources.tables import read_or_create, read_table, write_table
from depuse.sources.text import (
    DIRECT_EDGE_TYPE,
    TRANSITIVE_EDGE_TYPE,
    dependency_record_rejects,
    parse_adjacency,
    parse_dependency_records,
    parse_repository_logs,
    read_adjacency,
    read_dependency_records,
    read_graph,
    read_rejected_records,
    read_repository_logs,
    repository_log_rejects,
)

# Parameters of the named queries (shared with the oracle SQL).
MAX_IDLE_MS = driver.DEFAULT_MAX_IDLE_MS
REPORT_START = "2024-01-01T00-00Z"
REPORT_END = "2024-02-01T00-00Z"
WINDOW_START = "2024-01-08T00-00Z"
WINDOW_END = "2024-01-22T00-00Z"
SESSION_HOPS = 2
DEEP_HOPS = 40
TRAIL_DEPTH = 12
KHOP_DEPTH = 3
SWEEP_DEPTHS = (0, 1, 2, 3)
WINDOW_DAYS = ("2024-01-08", "2024-01-21")
FEW_CLIENTS = 4  # so that lists and bitmaps both occur at every scale
OFFSETS = {"Z": 0, "+01": 60, "-0530": -330, "+0845": 525, "-11": -660}  # minutes
REUSE_LEAST = (2, 3)
SAMPLE_GRID = (2, 40, 1, 10)  # min size, max size, step, sessions per size

Query = Callable[[SparkSession, str], DataFrame]


# -- shared building blocks ---------------------------------------------------


def gav_logs(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    logs = driver.repository_logs(spark, sf, with_event_id="event_id" in keep)
    return resolve_gavs(logs, driver.dependency_records(spark, sf), keep=keep)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.create_sessions(gav_logs(spark, sf), MAX_IDLE_MS)


def report_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.between(sessions(spark, sf), parse_bound(REPORT_START), parse_bound(REPORT_END))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.direct_edges(driver.dependency_records(spark, sf))


def enhanced(spark: SparkSession, sf: str, depth: int = D.DEFAULT_DEPTH) -> DataFrame:
    return D.compute_dependencies(report_sessions(spark, sf), edges(spark, sf), depth=depth)


def _session_text() -> list:
    return [
        "clientId",
        "sessionId",
        "startTime",
        "endTime",
        sorted_text(F.col("gavs")).alias("gavs"),
        F.size("gavs").alias("n_gavs"),
    ]


# -- sources and parsing --------------------------------------------------------


def q_parse_repository_logs(spark, sf):
    return parse_repository_logs(driver.repository_log_lines(spark, sf))


def q_parse_dependency_records(spark, sf):
    records = parse_dependency_records(driver.dependency_record_lines(spark, sf))
    return records.select(
        "path", "gav", sorted_text(F.col("dependencies")).alias("dependencies"),
        F.size("dependencies").alias("n_dependencies"),
    )


def q_rejected_lines(spark, sf):
    logs = repository_log_rejects(driver.repository_log_lines(spark, sf)).withColumn("kind", F.lit("log"))
    recs = dependency_record_rejects(driver.dependency_record_lines(spark, sf)).withColumn("kind", F.lit("record"))
    return logs.unionByName(recs).select("kind", "line")


def q_duplicate_paths(spark, sf):
    return Q.duplicate_paths(driver.records_by_name(spark, sf))


def q_unresolved_logs(spark, sf):
    logs = driver.repository_logs(spark, sf)
    return Q.unresolved_logs(logs, driver.dependency_records(spark, sf)).select("clientId", "timestamp", "agent", "path")


def q_resolve_gavs(spark, sf):
    return gav_logs(spark, sf).select(
        "clientId", "timestamp", "agent", "gav", sorted_text(F.col("dependencies")).alias("dependencies")
    )


def q_report_bounds(spark, sf):
    events = driver.table(spark, sf, "events")
    dash = F.date_format("ts", "yyyy-MM-dd'T'HH-mm'Z'")
    colon = F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")
    return events.select(
        "event_id",
        dash.alias("bound_text"),
        bound_millis(dash).alias("bound_ms"),
        bound_millis(colon).alias("bound_ms_colon"),
    )


def q_report_bounds_offsets(spark, sf):
    """Local times under several offsets name the instants they should."""
    events = driver.table(spark, sf, "events")
    zones = F.array(*[F.lit(z) for z in OFFSETS])
    zone = F.get(zones, F.pmod("event_id", F.lit(len(OFFSETS))).cast("int"))
    dash = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH-mm"), zone)
    colon = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), zone)
    return events.select(
        "event_id", dash.alias("bound_text"), bound_millis(dash).alias("bound_ms"), bound_millis(colon).alias("bound_ms_colon")
    )


# -- sessions -------------------------------------------------------------------


def q_session_flags(spark, sf):
    flagged = S.flag_sessions(gav_logs(spark, sf, keep=("event_id",)), MAX_IDLE_MS, tiebreak=("event_id",))
    # -1 stands for "no previous download" (first download of a client), so
    # the columns stay non-null integers in every result format
    none = F.lit(-1).cast("bigint")
    return flagged.select(
        "clientId", "timestamp", "event_id", "gav",
        F.coalesce("prev", none).alias("prev"), F.coalesce("diff", none).alias("diff"),
        "isNewSession", "sessionId",
    )


def q_sessions(spark, sf):
    return sessions(spark, sf).select(*_session_text())


def q_sessions_in_range(spark, sf):
    window = S.between(sessions(spark, sf), parse_bound(WINDOW_START), parse_bound(WINDOW_END))
    return window.select(*_session_text())


# -- graph --------------------------------------------------------------------------


def q_sentinel_filter(spark, sf):
    kept = G.retained_records(driver.sentinel_records(spark, sf))
    return kept.select(
        "path", "gav", sorted_text(F.col("dependencies")).alias("dependencies"),
        F.size("dependencies").alias("n_dependencies"),
    )


def q_graph_nodes(spark, sf):
    return G.graph_nodes(driver.dependency_records(spark, sf))


def q_graph_edges(spark, sf):
    return edges(spark, sf)


def q_graph_edges_valid(spark, sf):
    nodes = G.graph_nodes(driver.dependency_records(spark, sf))
    return G.validate_edges(driver.all_part_edges(spark, sf), nodes)


def q_adjacency_edges(spark, sf):
    return parse_adjacency(driver.adjacency_lines(spark, sf))[1]


def q_adjacency_stats(spark, sf):
    return G.graph_stats(*parse_adjacency(driver.adjacency_lines(spark, sf)))


def q_graph_stats(spark, sf):
    records = driver.dependency_records(spark, sf)
    return G.graph_stats(G.graph_nodes(records), G.direct_edges(records))


def q_khop_reach(spark, sf):
    seeds = gav_logs(spark, sf).select(F.col("gav").alias("id")).distinct()
    return G.reachable(edges(spark, sf), seeds=seeds, max_depth=KHOP_DEPTH)


def q_cyclic_reach(spark, sf):
    return G.reachable(driver.cyclic_edges(spark, sf))


def q_transitive_closure(spark, sf):
    return G.transitive_closure(edges(spark, sf))


# -- session dependencies --------------------------------------------------------------


def _deps_long(spark, sf, depth, closure=None):
    sess = G.materialise(report_sessions(spark, sf))
    seeds = S.session_gavs(sess).select(F.col("gav").alias("id")).distinct()
    reach = D.reach_for_depth(edges(spark, sf), depth, seeds=seeds, closure=closure)
    return D.session_dependencies(sess, reach)


def q_session_dependencies_closure(spark, sf):
    return _deps_long(spark, sf, 1, closure=G.transitive_closure(edges(spark, sf), packed=True))


def q_session_dependencies_hops(spark, sf):
    return _deps_long(spark, sf, SESSION_HOPS)


def q_session_dependencies_unbounded(spark, sf):
    return _deps_long(spark, sf, 0)


def q_session_dependencies_depth40(spark, sf):
    return _deps_long(spark, sf, DEEP_HOPS)


def q_enhanced_sessions(spark, sf):
    return enhanced(spark, sf).select(
        *_session_text(),
        sorted_text(F.col("dependencies")).alias("dependencies"),
        F.size("dependencies").alias("n_dependencies"),
        "execMillis",
        "errorDeps",
    )


def q_top_level_gavs(spark, sf):
    split = R.direct_indirect(enhanced(spark, sf))
    return split.select(
        "clientId", "sessionId", sorted_text(F.col("direct")).alias("direct"), F.size("direct").alias("n_direct")
    )


def q_sessions_with_dependencies(spark, sf):
    return R.sessions_with_dependencies(enhanced(spark, sf))


# -- reports ----------------------------------------------------------------------------


def q_direct_usage(spark, sf):
    return R.direct_usage(enhanced(spark, sf))


def q_indirect_usage(spark, sf):
    return R.indirect_usage(enhanced(spark, sf))


def q_direct_usage_by_day(spark, sf):
    report = R.usage_by_day(enhanced(spark, sf), "direct")
    return report.select(F.col("day").cast("string").alias("day"), "gav", "clients")


def q_indirect_usage_by_day(spark, sf):
    report = R.usage_by_day(enhanced(spark, sf), "indirect")
    return report.select(F.col("day").cast("string").alias("day"), "gav", "clients")


def q_usage_of_days(spark, sf):
    """Two weeks out of the month's client sets."""
    return U.usage_of_days(U.daily_parts(enhanced(spark, sf), sparse_up_to=FEW_CLIENTS), *WINDOW_DAYS)


def q_top10_direct(spark, sf):
    return R.top_k(R.direct_usage(enhanced(spark, sf)), 10)


def q_top10_indirect(spark, sf):
    return R.top_k(R.indirect_usage(enhanced(spark, sf)), 10)


# -- profile ------------------------------------------------------------------------------


def q_session_size_histogram(spark, sf):
    return P.session_size_histogram(sessions(spark, sf))


def _sample(spark, sf):
    lo, hi, step, n = SAMPLE_GRID
    return P.sample_by_size(sessions(spark, sf), lo, hi, step, n)


def q_sample_by_size(spark, sf):
    return _sample(spark, sf).select(*_session_text(), "gavsSize")


def q_depth_sweep(spark, sf):
    sweep = P.depth_sweep(G.materialise(_sample(spark, sf)), edges(spark, sf), SWEEP_DEPTHS)
    return sweep.withColumn("dependencies", sorted_text(F.col("dependencies")))


def q_traversal_work(spark, sf):
    long = S.session_gavs(G.materialise(report_sessions(spark, sf)))
    per_gav = G.traversal_work(edges(spark, sf), long.select(F.col("gav").alias("id")))
    joined = long.join(per_gav.withColumnRenamed("id", "gav"), "gav", "left")
    return joined.groupBy("clientId", "sessionId").agg(
        F.coalesce(F.sum("n_paths"), F.lit(0)).cast("bigint").alias("n_paths"),
        F.coalesce(F.sum("work"), F.lit(0)).cast("bigint").alias("work"),
    )


def q_session_traversal_work(spark, sf):
    return D.session_traversal_work(report_sessions(spark, sf), edges(spark, sf))


def q_cyclic_traversal_work(spark, sf):
    cyc = driver.cyclic_edges(spark, sf)
    nodes = cyc.select(F.col("src").alias("id")).unionByName(cyc.select(F.col("dst").alias("id"))).distinct()
    return G.traversal_work(cyc, nodes, max_depth=TRAIL_DEPTH)


def q_cyclic_traversal_unbounded(spark, sf):
    """Every edge-simple path, however long, counted from component to component."""
    cyc = driver.cyclic_edges(spark, sf)
    return G.traversal_work(cyc, cyc.select(F.col("src").alias("id")), mode="components")


# -- orders as downloads: artifacts grow with the scale -----------------------------------


def order_sessions(spark: SparkSession, sf: str) -> DataFrame:
    logs = resolve_gavs(driver.order_logs(spark, sf), driver.dependency_records(spark, sf))
    return S.create_sessions(logs, MAX_IDLE_MS)


def q_order_sessions(spark, sf):
    return order_sessions(spark, sf).select(*_session_text())


def q_order_session_dependencies(spark, sf):
    sess = G.materialise(order_sessions(spark, sf))
    return D.session_dependencies(sess, G.transitive_closure(edges(spark, sf), packed=True))


def q_order_direct_usage(spark, sf):
    return R.direct_usage(D.compute_dependencies(order_sessions(spark, sf), edges(spark, sf)))


# -- files and jobs -------------------------------------------------------------------------
#
# Each writes to a new folder under the shared folder of the cluster and reads
# the result back.


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _log_files(spark, sf) -> str:
    path = _scratch(spark)
    driver.repository_log_lines(spark, sf).write.text(path)
    return path


def _record_files(spark, sf) -> str:
    path = _scratch(spark)
    driver.dependency_record_lines(spark, sf).write.text(path)
    return path


def _record_text(records):
    return records.select(
        "path", "gav", sorted_text(F.col("dependencies")).alias("dependencies"),
        F.size("dependencies").alias("n_dependencies"),
    )


def q_file_repository_logs(spark, sf):
    return read_repository_logs(spark, _log_files(spark, sf))


def q_file_rejected_line_numbers(spark, sf):
    """Rejected record lines by their place in their file: files of up to 1,000
    parts in key order, one a folder."""
    path, key = _scratch(spark), F.col("p_partkey")
    lines = driver.dependency_record_lines(spark, sf, with_key=True).withColumn("folder", F.floor(key / 1000).cast("int"))
    placed = lines.repartition("folder").sortWithinPartitions("folder", "p_partkey")
    placed.select("folder", "value").write.partitionBy("folder").text(path)
    rejects = read_rejected_records(spark, f"{path}/*")
    folder = F.regexp_extract("file", "folder=([0-9]+)/", 1).cast("int")
    return rejects.select(folder.alias("folder"), "line_number", "line")


def q_file_dependency_records(spark, sf):
    return _record_text(read_dependency_records(spark, _record_files(spark, sf)))


def q_file_graph_records(spark, sf):
    """Records by name repeat paths, which the graph reader accepts."""
    path = _scratch(spark)
    records = driver.records_by_name(spark, sf)
    records.select(F.concat_ws(" ", F.lit("1"), "path", "gav", F.array_join("dependencies", ",")).alias("value")).write.text(path)
    return _record_text(read_dependency_records(spark, path, require_unique_path=False))


def q_file_parquet_table(spark, sf):
    """Overwritten once: the second table is what stays."""
    path, logs = _scratch(spark), driver.repository_logs(spark, sf)
    write_table(logs.withColumn("agent", F.lit("old")), path)
    write_table(logs, path, cluster_by=["clientId"])
    return read_table(spark, path)


def q_file_create_only(spark, sf):
    """The second write is refused and the first table stays."""
    path, logs = _scratch(spark), driver.repository_logs(spark, sf)
    write_table(logs, path, mode="errorifexists")
    try:
        write_table(logs.withColumn("agent", F.lit("new")), path, mode="errorifexists")
    except AnalysisException:
        return read_table(spark, path)
    raise AssertionError("an existing table was replaced")


def q_file_read_or_create(spark, sf):
    """Built and saved by the first call, reused by the second."""
    path, logs = _scratch(spark), driver.repository_logs(spark, sf)
    read_or_create(spark, path, lambda: logs)
    return read_or_create(spark, path, lambda: logs.withColumn("agent", F.lit("rebuilt")))


def q_file_reused_table(spark, sf):
    """Downloads per client of at least so many, as a managed table: built,
    reused, built for another parameter, built again for more input files."""
    path, logs = _scratch(spark), _log_files(spark, sf)

    def counted(least):
        lines = read_repository_logs(spark, logs)
        return lambda: lines.groupBy("clientId").agg(F.count(F.lit(1)).alias("downloads")).filter(F.col("downloads") >= least)

    def never():
        raise AssertionError("a table that still holds was built again")

    steps = [reuse_or_build(spark, path, counted(REUSE_LEAST[0]), {"least": REUSE_LEAST[0]}, [logs])]
    steps.append(reuse_or_build(spark, path, never, {"least": REUSE_LEAST[0]}, [logs]))
    steps.append(reuse_or_build(spark, path, counted(REUSE_LEAST[1]), {"least": REUSE_LEAST[1]}, [logs]))
    driver.repository_log_lines(spark, sf).write.mode("append").text(logs)
    steps.append(reuse_or_build(spark, path, counted(REUSE_LEAST[1]), {"least": REUSE_LEAST[1]}, [logs]))
    named = [step.withColumn("step", F.lit(k)) for k, step in enumerate(steps)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


def _files_in_order(rows: DataFrame, key):
    """Whether no file's least key is below the greatest of the file before
    it (a scalar; one row per file is compared)."""
    spans = rows.groupBy("file").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    before = F.lag("hi").over(Window.orderBy("file"))
    return spans.select((F.coalesce(before <= F.col("lo"), F.lit(True))).alias("ok")).agg(F.bool_and("ok").alias("ok")).scalar()


def _graph_files(spark, sf, closure=False):
    path = _scratch(spark)
    nodes, direct = G.build_graph(driver.dependency_records(spark, sf))
    direct = G.materialise(direct)
    G.write_graph(nodes, direct, f"{path}/nodes", f"{path}/edges", G.transitive_closure(direct) if closure else None)
    return f"{path}/nodes", f"{path}/edges"


def q_file_graph_nodes(spark, sf):
    """Node file lines with their places: sorted by id across all files."""
    nodes, _ = _graph_files(spark, sf)
    lines = spark.read.csv(nodes, sep="|", header=True, schema="id string, label string")
    named = lines.select("id", "label", F.col("_metadata.file_name").alias("file"))
    return named.select("id", "label", _files_in_order(named, F.col("id")).alias("sorted"))


def q_file_graph_edges(spark, sf):
    """Both edge types, read one after the other."""
    files = _graph_files(spark, sf, closure=True)
    kinds = [read_graph(spark, *files, kind)[1].withColumn("type", F.lit(kind)) for kind in (DIRECT_EDGE_TYPE, TRANSITIVE_EDGE_TYPE)]
    return kinds[0].unionByName(kinds[1])


def q_file_usage_report(spark, sf):
    direct, indirect = R.write_report(G.materialise(enhanced(spark, sf)), _scratch(spark), "2024-01-01T00:00Z", "2024-02-01T00:00Z")
    read = lambda path, kind: spark.read.csv(path, schema="gav string, clients long").withColumn("kind", F.lit(kind))
    return read(direct, "direct").unionByName(read(indirect, "indirect"))


def q_file_adjacency(spark, sf):
    path = _scratch(spark)
    driver.adjacency_lines(spark, sf).write.text(path)
    return read_adjacency(spark, path)[0]


def _jobs(spark, sf) -> str:
    """Graph, resolved logs and sessions as the jobs write them."""
    out, records = _scratch(spark), _record_files(spark, sf)
    jobs.build_graph(spark, records, f"{out}/graph")
    jobs.resolve(spark, _log_files(spark, sf), records, f"{out}/gav_logs")
    jobs.sessionise(spark, f"{out}/gav_logs", f"{out}/sessions", MAX_IDLE_MS)
    return out


def q_job_build_graph(spark, sf):
    counts = jobs.build_graph(spark, _record_files(spark, sf), _scratch(spark))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


def q_job_resolve(spark, sf):
    """Resolved logs of the job, with whether each file is in its order."""
    path = _scratch(spark)
    jobs.resolve(spark, _log_files(spark, sf), _record_files(spark, sf), path)
    rows = read_table(spark, path).select("clientId", "timestamp", "agent", "gav", F.col("_metadata.file_name").alias("file"))
    in_order = _files_in_order(rows, F.struct("clientId", "timestamp"))
    return rows.select("clientId", "timestamp", "agent", "gav", in_order.alias("sorted"))


def q_job_sessionise(spark, sf):
    """Sessions table of the job with its partition day."""
    table = read_table(spark, f"{_jobs(spark, sf)}/sessions")
    return table.select(*_session_text(), F.col(S.DAY_COLUMN).cast("string").alias("day"))


def q_job_dependencies(spark, sf):
    out = _jobs(spark, sf)
    jobs.compute_dependencies(spark, f"{out}/sessions", f"{out}/graph", f"{out}/enhanced", WINDOW_START, WINDOW_END)
    table = read_table(spark, f"{out}/enhanced")
    return table.select("clientId", "sessionId", sorted_text(F.col("dependencies")).alias("dependencies"), F.size("dependencies").alias("n_dependencies"))


def q_job_dependencies_hops(spark, sf):
    """The hop limit counts direct edges, though the graph holds its closure."""
    out = _jobs(spark, sf)
    jobs.compute_dependencies(
        spark, f"{out}/sessions", f"{out}/graph", f"{out}/enhanced", REPORT_START, REPORT_END, depth=SESSION_HOPS
    )
    table = read_table(spark, f"{out}/enhanced")
    return table.select("clientId", "sessionId", F.explode("dependencies").alias("dependency"))


def q_job_report(spark, sf):
    out = _jobs(spark, sf)
    jobs.compute_dependencies(spark, f"{out}/sessions", f"{out}/graph", f"{out}/enhanced", REPORT_START, REPORT_END)
    direct, _ = jobs.report(spark, f"{out}/enhanced", f"{out}/reports", REPORT_START, REPORT_END)
    return spark.read.csv(direct, schema="gav string, clients long")


def _job_enhanced(spark, sf) -> str:
    out = _jobs(spark, sf)
    jobs.compute_dependencies(spark, f"{out}/sessions", f"{out}/graph", f"{out}/enhanced", REPORT_START, REPORT_END)
    return out


def _both(spark, paths, schema) -> DataFrame:
    direct, indirect = (
        spark.read.csv(path, schema=schema).withColumn("kind", F.lit(kind)) for path, kind in zip(paths, ("direct", "indirect"))
    )
    return direct.unionByName(indirect)


def q_job_daily_report(spark, sf):
    out = _job_enhanced(spark, sf)
    paths = jobs.daily_report(spark, f"{out}/enhanced", f"{out}/reports", REPORT_START, REPORT_END)
    both = _both(spark, paths, "gav string, clients long, day date")
    return both.select("kind", F.col("day").cast("string").alias("day"), "gav", "clients")


def q_job_report_days(spark, sf):
    """Client sets of the month, two weeks of them redone, then one report."""
    out = _job_enhanced(spark, sf)
    for start, end in ((REPORT_START, REPORT_END), (WINDOW_START, WINDOW_END)):
        jobs.daily_parts(spark, f"{out}/enhanced", f"{out}/parts", start, end)
    return _both(spark, jobs.report_days(spark, f"{out}/parts", f"{out}/reports", *WINDOW_DAYS), "gav string, clients long")


def q_job_depth_sweep(spark, sf):
    out = _jobs(spark, sf)
    return jobs.depth_sweep(spark, f"{out}/sessions", f"{out}/graph", f"{out}/sweep", SWEEP_DEPTHS, SAMPLE_GRID).select(
        "depth", "clientId", "sessionId", "n_dependencies", sorted_text(F.col("dependencies")).alias("dependencies")
    )


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which artifacts did most distinct clients choose directly?"""
    return R.ordered(R.direct_usage(enhanced(spark, sf)))
