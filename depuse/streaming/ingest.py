"""Resolve repository logs as their files arrive.

The same parsing (S1) and path join (J1) as the batch resolver, over a file
stream: a stream-static inner join with the dependency records, appended to
a parquet gav-log table.  ``Trigger.AvailableNow`` processes whatever has
arrived and stops, so a scheduler can run it like a batch job that only
reads new files.  The stream's progress lives beside its output
(``<output>-progress``) unless a location is given, so the next run finds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from depuse.operators.resolve import resolve_gavs
from depuse.sources.text import parse_repository_logs


def stream_repository_logs(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``clientId, timestamp, agent, path`` from text files under
    ``path``; malformed lines are dropped."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_repository_logs(reader.load(path))


def resolve_stream(
    spark: SparkSession,
    logs_path: str,
    records: DataFrame,
    gav_logs_path: str,
    checkpoint_location: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start appending resolved gav logs of new files to ``gav_logs_path``."""
    location = checkpoint_location or gav_logs_path.rstrip("/") + "-progress"
    resolved = resolve_gavs(stream_repository_logs(spark, logs_path), records, salt=False)
    writer = resolved.writeStream.format("parquet").option("checkpointLocation", location).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(gav_logs_path)
