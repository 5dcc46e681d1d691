"""Placeholder values that can stand for a dependency list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dependency-list sentinels of the record format.
SENTINELS = ("UNKNOWN_DEPS", "NO_DEPS")


def _sentinel_array() -> Column:
    return F.array(*[F.lit(s) for s in SENTINELS])


def is_sentinel_only(deps: Column) -> Column:
    """True when the (set of) dependencies is exactly one sentinel.

    Such a record adds neither node nor edge.  A list holding several
    sentinels, or sentinels mixed with real gavs, is not sentinel-only.
    """
    distinct = F.array_distinct(deps)
    return F.coalesce(
        (F.size(distinct) == 1) & F.element_at(distinct, 1).isin(*SENTINELS),
        F.lit(False),
    )


def strip_sentinels(deps: Column) -> Column:
    """Dependencies without any sentinel (as a set)."""
    return F.array_except(F.coalesce(deps, F.array().cast("array<string>")), _sentinel_array())
