"""The first n rows of every group, ranked in two bounded steps.

A plain ``row_number() <= n`` brings up to n rows of every map task to the one
task that holds the group, so that task grows with the input.  Here a group is
first dealt into ``salts`` parts by a hash of its rows and each part keeps its
own first n (what is among the group's first n is among its part's), so the
last task of a group reads at most ``n * salts`` rows however large the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, lengthened by underscores until no column is called so
    (names are compared as Spark does, without regard to case)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def top_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    out: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """The rows of ``df`` among the first ``n`` of their ``group`` by ``order``.

    ``spread`` names the columns whose hash deals a group into parts; any that
    tell most rows apart will do, they never change the result.  ``order``
    should be total: rows that tie in it are interchangeable.  ``out`` adds the
    rank (int, from 1).  Null groups count as one group.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be >= 1")
    group = list(group)
    part, rank = free_name(df.columns, "_part"), free_name(df.columns, "_rank")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(salts)))
    within = Window.partitionBy(*[F.col(f"`{c}`") for c in [*group, part]]).orderBy(*order)
    firsts = dealt.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= n).drop(rank, part)
    whole = Window.partitionBy(*[F.col(f"`{c}`") for c in group]).orderBy(*order)
    ranked = firsts.withColumn(out or rank, F.row_number().over(whole)).filter(F.col(out or rank) <= n)
    return ranked if out else ranked.drop(rank)
