"""Joins whose probe side may have hot keys.

A key holding a large share of the rows would put that share into one
shuffle partition.  ``salted_join`` spreads the rows of the hot keys of the
large side over ``salts`` sub-partitions (by a hash of the row, so retries
see the same assignment) and copies the matching rows of the other side into
each of them; other keys are joined as usual.  Hot keys are keys whose row
count exceeds ``min_share`` of all rows, so there are at most
``1 / min_share`` of them; that list is marked for broadcast only while this
bound is at most ``BROADCAST_KEYS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depuse.operators.topn import free_name

DEFAULT_MIN_SHARE = 0.01
DEFAULT_SALTS = 32
BROADCAST_KEYS = 1000
GROUP_SHIFT = 48  # leaves 65,536 hash groups, never null


def hot_keys(df: DataFrame, keys: Sequence[str], min_share: float = DEFAULT_MIN_SHARE, coarse: bool = False) -> DataFrame:
    """Keys with more than ``min_share`` of the rows (at most ``1/min_share``).

    Lazy: the threshold is a scalar subquery over the same counts, so nothing
    runs until the join that uses it does.  Null keys, which no join matches, are
    left out, as the join's own plan does: what lies below is then shuffled once.
    ``coarse`` counts 65,536 hash groups of the keys first and then only
    the keys of groups that have so many rows: mostly none, so that no key is
    shuffled, but ``df`` is read once more where there are some.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be in (0, 1]")
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    if coarse:
        group = free_name(df.columns, "_group")
        df = df.select(*keys, F.shiftright(F.xxhash64(*keys), GROUP_SHIFT).alias(group))
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
        total = sizes.select((F.sum("_n") * F.lit(min_share)).alias("_t")).scalar()
        large = sizes.filter(F.col("_n") > total).select(group)
        df = df.join(F.broadcast(large) if min_share * BROADCAST_KEYS >= 1 else large, group, "left_semi")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if not coarse:
        total = counts.select((F.sum("_n") * F.lit(min_share)).alias("_t")).scalar()
    return counts.filter(F.col("_n") > total).select(*keys)


def salted_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
    min_share: float = DEFAULT_MIN_SHARE,
    hot: DataFrame | None = None,
    hot_bounded: bool = False,
) -> DataFrame:
    """``large.join(small, on, how)`` with the hot keys of ``large`` salted.

    A caller's own ``hot`` table is broadcast only if it says that the table
    comes from ``hot_keys`` with this ``min_share`` (``hot_bounded``).
    ``how`` is one where every ``large`` row is matched independently
    (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support how={how!r}")
    on = list(on)
    bounded = hot is None or hot_bounded
    if hot is None:
        hot = hot_keys(large, on, min_share)
    taken = [*large.columns, *small.columns]
    salt, is_hot = free_name(taken, "_salt"), free_name(taken, "_hot")
    flags = hot.select(*on).withColumn(is_hot, F.lit(True))
    if bounded and min_share * BROADCAST_KEYS >= 1:
        flags = F.broadcast(flags)
    row_hash = F.xxhash64(*[F.col(c) for c in large.columns])
    salted_large = (
        large.join(flags, on, "left")
        .withColumn(salt, F.when(F.col(is_hot), F.pmod(row_hash, F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        .drop(is_hot)
    )
    copies = F.when(F.col(is_hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_small = (
        small.join(flags, on, "left").withColumn(salt, F.explode(copies)).drop(is_hot)
    )
    return salted_large.join(salted_small, on + [salt], how).drop(salt)
