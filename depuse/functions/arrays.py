"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_level(gavs: Column, dependencies: Column) -> Column:
    """Gavs of a session that no other gav of it depends on.

    A null ``dependencies`` (failed computation) makes every gav top level.
    Both inputs are sets, so the set difference equals the list difference.
    """
    return F.array_except(gavs, F.coalesce(dependencies, F.array().cast("array<string>")))


def sorted_text(values: Column, sep: str = ",") -> Column:
    """Order-free rendering of a string array: sorted, joined."""
    return F.array_join(F.array_sort(values), sep)


def bit_is_set(bits: Column, place: Column) -> Column:
    """Whether a bitmap (as ``bitmap_construct_agg`` makes them) has a place."""
    at = place.cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0
