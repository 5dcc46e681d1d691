"""Session-size profile: histogram, stratified sample, depth sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depuse.operators.graph import reachable
from depuse.operators.sessions import session_gavs
from depuse.operators.topn import top_rows

# The sampling grid used when none is given.
DEFAULT_MIN_SIZE = 2
DEFAULT_MAX_SIZE = 40
DEFAULT_STEP = 1
DEFAULT_PER_SIZE = 10


def with_size(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("gavsSize", F.size("gavs"))


def session_size_histogram(sessions: DataFrame) -> DataFrame:
    """``gavsSize, count``: number of sessions of each size."""
    return with_size(sessions).groupBy("gavsSize").agg(F.count(F.lit(1)).alias("count"))


def sample_by_size(
    sessions: DataFrame,
    min_size: int = DEFAULT_MIN_SIZE,
    max_size: int = DEFAULT_MAX_SIZE,
    step: int = DEFAULT_STEP,
    per_size: int = DEFAULT_PER_SIZE,
) -> DataFrame:
    """At most ``per_size`` sessions of every size ``min_size, min_size+step,
    ... <= max_size``, the first ones by (clientId, sessionId).

    One pass in two steps (``top_rows``): a size shared by most sessions is
    ranked in parts first, so its last task reads at most ``per_size`` rows of
    each part, however many map tasks there are.
    """
    if min_size < 2:
        raise ValueError("min_size must be >= 2")
    if max_size < min_size:
        raise ValueError("max_size must be >= min_size")
    if step < 1 or per_size < 1:
        raise ValueError("step and per_size must be >= 1")
    sizes = list(range(min_size, max_size + 1, step))
    sized = with_size(sessions).filter(F.col("gavsSize").isin(sizes))
    return top_rows(sized, ["gavsSize"], [F.asc("clientId"), F.asc("sessionId")], per_size, ["clientId", "sessionId"])


def depth_sweep(
    sample: DataFrame,
    edges: DataFrame,
    depths: Sequence[int] = (1,),
) -> DataFrame:
    """``depth, clientId, sessionId, n_dependencies, dependencies`` (sorted)
    for every depth setting.

    One unbounded traversal from the sample's gavs records the least hop
    count of every reachable pair; a depth ``k >= 2`` keeps pairs within
    ``k`` hops and depths 0 and 1 keep all (both mean the exact closure).
    """
    if any(d < 0 for d in depths):
        raise ValueError("depths must be >= 0")
    gavs_long = session_gavs(sample)
    seeds = gavs_long.select(F.col("gav").alias("id")).distinct()
    reach = reachable(edges, seeds=seeds)
    starts = gavs_long.select("clientId", "sessionId", F.col("gav").alias("src"))
    nearest = (
        starts.join(reach, "src")
        .join(
            gavs_long.select("clientId", "sessionId", F.col("gav").alias("dst")),
            ["clientId", "sessionId", "dst"],
            "left_semi",
        )
        .groupBy("clientId", "sessionId", "dst")
        .agg(F.min("hops").alias("hops"))
    )
    grid = sample.select(
        "clientId", "sessionId", F.explode(F.array(*[F.lit(int(d)) for d in depths])).alias("depth")
    )
    limit = F.when(F.col("depth") <= 1, F.lit(None)).otherwise(F.col("depth"))
    within = F.col("hops").isNotNull() & (limit.isNull() | (F.col("hops") <= limit))
    return (
        grid.join(nearest, ["clientId", "sessionId"], "left")
        .groupBy("depth", "clientId", "sessionId")
        .agg(
            F.sum(F.when(within, 1).otherwise(0)).cast("bigint").alias("n_dependencies"),
            F.array_sort(F.collect_list(F.when(within, F.col("dst")))).alias("dependencies"),
        )
    )
