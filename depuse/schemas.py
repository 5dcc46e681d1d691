"""Schemas of the pipeline's tables (all times are epoch-millisecond longs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_str = T.StringType()
_arr = T.ArrayType(T.StringType(), True)

REPOSITORY_LOG = T.StructType([
    T.StructField("clientId", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("agent", _str),
    T.StructField("path", _str),
])

DEPENDENCY_RECORD = T.StructType([
    T.StructField("path", _str),
    T.StructField("gav", _str),
    T.StructField("dependencies", _arr),
])

GAV_LOG = T.StructType([
    T.StructField("clientId", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("agent", _str),
    T.StructField("gav", _str),
    T.StructField("dependencies", _arr),
])

SESSION = T.StructType([
    T.StructField("clientId", T.IntegerType()),
    T.StructField("sessionId", T.LongType()),
    T.StructField("startTime", T.LongType()),
    T.StructField("endTime", T.LongType()),
    T.StructField("gavs", _arr),
])

ENHANCED_SESSION = T.StructType(SESSION.fields + [
    T.StructField("dependencies", _arr),
    T.StructField("execMillis", T.LongType()),
    T.StructField("errorDeps", _str),
])

NODES = T.StructType([T.StructField("id", _str)])
EDGES = T.StructType([T.StructField("src", _str), T.StructField("dst", _str)])

USAGE_REPORT = T.StructType([
    T.StructField("gav", _str),
    T.StructField("clients", T.LongType()),
])


def check_columns(df: DataFrame, schema: T.StructType, what: str) -> None:
    """Raise if ``df`` lacks a column of ``schema`` or has it with another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in schema.fields:
        if field.name not in have:
            problems.append(f"missing {field.name}")
        elif have[field.name].simpleString() != field.dataType.simpleString():
            problems.append(
                f"{field.name} is {have[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    if problems:
        raise ValueError(f"{what}: " + "; ".join(problems))
