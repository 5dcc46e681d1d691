"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_paths(records: DataFrame) -> DataFrame:
    """``path, n`` for every path held by more than one record.

    One aggregation with map-side combine: a path repeated a billion times
    still reaches the reducer as one partial count per input split.
    """
    return (
        records.groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


class DuplicatePathError(ValueError):
    pass


def assert_unique_paths(records: DataFrame, examples: int = 5) -> None:
    """Raise ``DuplicatePathError`` naming some duplicated paths, if any."""
    found = duplicate_paths(records).orderBy(F.desc("n"), "path").take(examples)
    if found:
        listed = ", ".join(f"{r['path']} (x{r['n']})" for r in found)
        raise DuplicatePathError(f"dependency records repeat paths: {listed}")


def unresolved_logs(logs: DataFrame, records: DataFrame) -> DataFrame:
    """Log rows whose path has no record (they vanish in gav resolution)."""
    return logs.join(records.select("path"), "path", "left_anti")
