"""Line formats of the two text inputs, as column expressions.

A repository log line is ``clientId timestamp agent path`` and a dependency
record line is ``occurrences path gav dep1,dep2,...``, single-space separated.
A line must match its pattern as a whole: a trailing extra field rejects it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted line formats (whole-line match).
LOG_LINE_PATTERN = r"^(\d+) (\d+) (\S+) (\S+)\z"
RECORD_LINE_PATTERN = r"^(\d+) (\S+) (\S+) (\S+)\z"


def is_well_formed(line: Column, pattern: str) -> Column:
    """True for lines matching ``pattern``; null and empty lines give False."""
    return F.coalesce(line.rlike(pattern), F.lit(False))


def _number(text: Column, type_name: str, field: str, on_overflow: str) -> Column:
    parsed = text.try_cast(type_name)
    if on_overflow == "reject":
        return parsed
    if on_overflow != "fail":
        raise ValueError("on_overflow must be 'fail' or 'reject'")
    # A well-formed number that does not fit fails the job, whatever the ANSI
    # setting of the session.
    return F.coalesce(
        parsed,
        F.raise_error(F.concat(F.lit(f"{field} out of range: "), text)).cast(type_name),
    )


def log_fields(line: Column, on_overflow: str = "fail") -> list[Column]:
    """``clientId INT, timestamp BIGINT, agent STRING, path STRING``."""
    group = lambda i: F.regexp_extract(line, LOG_LINE_PATTERN, i)
    return [
        _number(group(1), "int", "clientId", on_overflow).alias("clientId"),
        _number(group(2), "bigint", "timestamp", on_overflow).alias("timestamp"),
        group(3).alias("agent"),
        group(4).alias("path"),
    ]


def split_dependencies(text: Column) -> Column:
    """Comma list -> distinct array, first-seen order.

    Trailing empty items are dropped and leading or inner ones kept, which is
    how the record format is split; a list of only commas is empty.
    """
    trimmed = F.regexp_replace(text, ",+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(trimmed, ","))
    )


def record_fields(line: Column) -> list[Column]:
    """``path STRING, gav STRING, dependencies ARRAY<STRING>``; the leading
    occurrence count is matched and dropped."""
    group = lambda i: F.regexp_extract(line, RECORD_LINE_PATTERN, i)
    return [
        group(2).alias("path"),
        group(3).alias("gav"),
        split_dependencies(group(4)).alias("dependencies"),
    ]
