"""Usage reports: distinct clients per gav, direct and indirect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depuse.functions.arrays import top_level
from depuse.functions.time import bound_name, millis_to_day


def direct_indirect(enhanced: DataFrame) -> DataFrame:
    """Per session: ``direct`` (gavs nothing else in it depends on) and
    ``indirect`` (its dependencies).  Null dependencies: all direct, none
    indirect."""
    return enhanced.select(
        "clientId",
        "sessionId",
        "startTime",
        "endTime",
        "gavs",
        top_level(F.col("gavs"), F.col("dependencies")).alias("direct"),
        F.col("dependencies").alias("indirect"),
    )


def _usage(sessions: DataFrame, column: str, by_day: bool = False) -> DataFrame:
    keys = ["gav"]
    cols = ["clientId", F.explode(column).alias("gav")]
    if by_day:
        cols.append(millis_to_day(F.col("startTime")).alias("day"))
        keys = ["day", "gav"]
    # count(distinct) is planned as (keys, clientId) dedupe then a count with
    # map-side partial sums, so a gav used by most clients is not one task.
    return sessions.select(*cols).groupBy(*keys).agg(F.count_distinct("clientId").alias("clients"))


def ordered(report: DataFrame) -> DataFrame:
    """Report order: most clients first, then gav."""
    keys = [F.desc("clients")] + [F.col(c) for c in report.columns if c not in ("clients",)]
    return report.orderBy(*keys)


def direct_usage(enhanced: DataFrame) -> DataFrame:
    """``gav, clients``: distinct clients that chose each gav directly."""
    return _usage(direct_indirect(enhanced), "direct")


def indirect_usage(enhanced: DataFrame) -> DataFrame:
    """``gav, clients``: distinct clients that got each gav as a dependency."""
    return _usage(direct_indirect(enhanced), "indirect")


def usage_by_day(enhanced: DataFrame, kind: str = "direct") -> DataFrame:
    """``day, gav, clients`` with ``day`` the UTC date of the session start."""
    if kind not in ("direct", "indirect"):
        raise ValueError("kind must be 'direct' or 'indirect'")
    return _usage(direct_indirect(enhanced), kind, by_day=True)


def top_k(report: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` gavs with most clients (ties broken by gav)."""
    return report.orderBy(F.desc("clients"), F.asc("gav")).limit(k)


def sessions_with_dependencies(enhanced: DataFrame, with_dependencies: bool = True) -> DataFrame:
    """Sessions where some gav is a dependency of another (or, with
    ``False``, sessions where none is), with their sizes."""
    split = direct_indirect(enhanced).select(
        "clientId",
        "sessionId",
        F.size("gavs").alias("n_gavs"),
        F.size("direct").alias("n_direct"),
        F.size(F.coalesce("indirect", F.array().cast("array<string>"))).alias("n_indirect"),
    )
    differs = F.col("n_gavs") != F.col("n_direct")
    return split.filter(differs if with_dependencies else ~differs)


def write_report(
    enhanced: DataFrame,
    report_dir: str,
    start_text: str,
    end_text: str,
) -> tuple[str, str]:
    """Write ``<start>_<end>_direct.csv`` and ``..._indirect.csv`` (headerless
    ``gav,clients``, ordered by clients descending).  Returns the two paths."""
    return write_usage(direct_usage(enhanced), indirect_usage(enhanced), report_dir, start_text, end_text)


def write_usage(
    direct: DataFrame, indirect: DataFrame, report_dir: str, start_text: str, end_text: str
) -> tuple[str, str]:
    """Write two ``gav, clients`` tables as ``write_report`` does."""
    prefix = report_dir.rstrip("/") + f"/{bound_name(start_text)}_{bound_name(end_text)}_"
    paths = (prefix + "direct.csv", prefix + "indirect.csv")
    for report, path in zip((direct, indirect), paths):
        ordered(report).write.mode("overwrite").csv(path)
    return paths


def write_daily_reports(enhanced: DataFrame, report_dir: str) -> tuple[str, str]:
    """Per-day usage: ``<dir>/direct`` and ``<dir>/indirect``, each a CSV
    table partitioned by ``day`` (UTC date of the session start), one folder
    ``day=YYYY-MM-DD`` per day holding headerless ``gav,clients`` rows."""
    base = report_dir.rstrip("/")
    paths = (f"{base}/direct", f"{base}/indirect")
    for kind, path in zip(("direct", "indirect"), paths):
        daily = usage_by_day(enhanced, kind)
        # range partitions over (day, gav): each task writes a slice of one or
        # two days, never a whole day
        (
            daily.repartitionByRange("day", "gav")
            .sortWithinPartitions("day", F.desc("clients"), "gav")
            .write.mode("overwrite")
            .partitionBy("day")
            .csv(path)
        )
    return paths
