"""Gav resolution: repository logs joined to dependency records on path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from depuse.operators.skew import hot_keys, salted_join


def resolve_gavs(
    logs: DataFrame,
    records: DataFrame,
    sort: bool = False,
    keep: Sequence[str] = (),
    salt: bool = True,
) -> DataFrame:
    """``clientId, timestamp, agent, gav, dependencies`` per resolvable log row.

    An inner equi-join on ``path``: logs with an unknown path vanish and
    repeated log lines stay.  The strategy is left to AQE: records are
    broadcast only when their measured size is under the broadcast threshold,
    otherwise both sides are hash-partitioned on path.  ``salt`` counts the
    paths first (one more pass over that column, by hash groups; a second one if a
    group is large) and spreads those with a large share of the logs; without it a hot path's partition is left to the
    skew-join rule.  ``sort`` range-partitions the result by (clientId,
    timestamp), the layout sessionisation reads best.
    """
    left = logs.select("clientId", "timestamp", "agent", "path", *keep)
    right = records.select("path", "gav", "dependencies")
    joined = left.join(right, "path", "inner")
    if salt:
        joined = salted_join(left, right, ["path"], hot=hot_keys(left, ["path"], coarse=True), hot_bounded=True)
    out = joined.select("clientId", "timestamp", "agent", "gav", "dependencies", *keep)
    if sort:
        out = out.repartitionByRange("clientId", "timestamp").sortWithinPartitions("clientId", "timestamp")
    return out
