"""Long columns on their way through pandas.

A long column with nulls becomes a float column in pandas, which cannot hold
large ids.  Carried longs therefore travel as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _longs(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema if f.name in columns and f.dataType.typeName() == "long"]


def as_text(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with the long ones of ``columns`` as text, and their names."""
    names = _longs(df, columns)
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in names}), names


def as_longs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in names})


def fields(df: DataFrame, columns: Sequence[str]) -> str:
    """DDL of the columns, in their order."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {types[c]}" for c in columns)
