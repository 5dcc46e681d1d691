"""Parquet tables between pipeline stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with ``schema`` nothing is inferred from the files."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    cluster_by: Sequence[str] | None = None,
) -> None:
    """Parquet sink.  ``mode="errorifexists"`` refuses to replace a table.

    ``cluster_by`` sorts rows within each output file so the min/max
    statistics of those columns let later range filters skip row groups.
    """
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_or_create(
    spark: SparkSession,
    path: str,
    create: Callable[[], DataFrame],
    reuse: bool = True,
    save: bool = True,
) -> DataFrame:
    """Reuse a materialised table if present, else build it (and save it).

    After saving, the table is read back so later stages start from the
    written files rather than recomputing ``create``.
    """
    if reuse:
        try:
            return spark.read.parquet(path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err.getCondition() or err):
                raise
    df = create()
    if not save:
        return df
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
