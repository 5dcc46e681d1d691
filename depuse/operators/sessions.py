"""Sessionisation: a client's downloads with no idle gap above ``max_idle_ms``.

A new session starts at a download whose time exceeds the previous download
of the same client by more than ``max_idle_ms`` (strictly); session ids count
from 0 per client in time order.

Instead of one window over every log row of a client (a hot client would sit
in one task), time is cut into buckets of ``max_idle_ms + 1`` ms.  Two
downloads in one bucket are at most ``max_idle_ms`` apart, so only the first
download of a bucket can open a session, and it does exactly when the
client's previous non-empty bucket ended more than ``max_idle_ms`` earlier.
The window therefore runs over one pre-aggregated row per (client, bucket),
and the log rows themselves only go through aggregations with map-side
combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depuse.operators.placed import PlacedTable


def idle_bucket(ts: Column, max_idle_ms: int) -> Column:
    """Index of the ``max_idle_ms + 1`` wide time bucket holding ``ts``."""
    if max_idle_ms < 0:
        raise ValueError("max_idle_ms must be >= 0")
    width = F.lit(max_idle_ms + 1)
    return ((ts - F.pmod(ts, width)) / width).cast("bigint")


def _bucket_rollup(gav_logs: DataFrame, max_idle_ms: int) -> DataFrame:
    """``clientId, bucket, startTime, endTime, gavs`` per non-empty bucket."""
    return (
        gav_logs.select("clientId", "timestamp", "gav", idle_bucket(F.col("timestamp"), max_idle_ms).alias("bucket"))
        .groupBy("clientId", "bucket")
        .agg(
            F.min("timestamp").alias("startTime"),
            F.max("timestamp").alias("endTime"),
            F.collect_set("gav").alias("gavs"),
        )
    )


def bucket_sessions(spans: DataFrame, max_idle_ms: int) -> DataFrame:
    """Session id of every (client, bucket) from per-bucket time spans.

    Input ``clientId, bucket, startTime, endTime``; output adds ``prevEnd``
    (end of the client's previous non-empty bucket) and ``sessionId``.
    """
    by_client = Window.partitionBy("clientId").orderBy("bucket")
    prev_end = F.lag("endTime", 1).over(by_client)
    flagged = spans.select("clientId", "bucket", "startTime", "endTime", prev_end.alias("prevEnd"))
    opens = F.when(
        F.col("prevEnd").isNull() | (F.col("startTime") - F.col("prevEnd") > F.lit(max_idle_ms)), 1
    ).otherwise(0)
    running = F.sum(opens).over(by_client.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.withColumn("sessionId", (running - 1).cast("bigint"))


def create_sessions(gav_logs: DataFrame, max_idle_ms: int, materialise_rollup: bool = True) -> DataFrame:
    """``clientId INT, sessionId BIGINT, startTime BIGINT, endTime BIGINT,
    gavs ARRAY<STRING>`` (gavs is a sorted set).

    Reads ``clientId, timestamp, gav`` of the gav logs.  The per-bucket
    rollup feeds both the session-id window and the final rows; it is written
    once, to buckets of (client, bucket) (``materialise_rollup``), so the logs are
    scanned once and the gavs stay in place when the session ids come to them.
    A session of one bucket is that bucket's row; only those of several buckets
    are aggregated.
    """
    rollup = _bucket_rollup(gav_logs, max_idle_ms)
    if materialise_rollup:
        table = PlacedTable(rollup.sparkSession, ["clientId", "bucket"], small=0)
        table.append(rollup)
        rollup = table.all()
    ids = bucket_sessions(rollup.select("clientId", "bucket", "startTime", "endTime"), max_idle_ms)
    by_client = Window.partitionBy("clientId").orderBy("bucket")
    near = [F.coalesce(at("sessionId").over(by_client) != F.col("sessionId"), F.lit(True)) for at in (F.lag, F.lead)]
    ids = ids.select("clientId", "bucket", "sessionId", (near[0] & near[1]).alias("_alone"))
    alone = rollup.join(ids.filter("_alone").drop("_alone"), ["clientId", "bucket"]).filter(F.size("gavs") > 0)
    parts = rollup.join(ids.filter("NOT _alone").drop("_alone"), ["clientId", "bucket"])
    merged = (
        parts.select("clientId", "sessionId", "startTime", "endTime", F.explode("gavs").alias("gav"))
        .groupBy("clientId", "sessionId")
        .agg(
            F.min("startTime").alias("startTime"),
            F.max("endTime").alias("endTime"),
            F.array_sort(F.collect_set("gav")).alias("gavs"),
        )
    )
    return alone.select("clientId", "sessionId", "startTime", "endTime", F.array_sort("gavs").alias("gavs")).unionByName(merged)


def flag_sessions(
    gav_logs: DataFrame,
    max_idle_ms: int,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Per download: ``prev`` (previous download time of the client), ``diff``,
    ``isNewSession`` (0/1) and ``sessionId``.

    ``tiebreak`` orders downloads with equal timestamps; it changes ``prev``
    only for tied rows (the first gets the previous distinct time, the others
    their own time), never the sessions.  It should identify a download
    within its (client, timestamp), like an event id.

    No window runs over a client's rows: the previous distinct time comes
    from a window over the *distinct timestamps* of a (client, bucket), at
    most ``max_idle_ms + 1`` values however many downloads share them, with
    the previous bucket's end for a bucket's first timestamp.  The first of
    tied rows is found by an aggregation (the least tiebreak per client and
    millisecond) and a join, both of which split hot keys.  Without a tiebreak
    all other columns serve as one, and fully equal rows are interchangeable.
    """
    from depuse.operators.graph import materialise

    columns = gav_logs.columns
    copy = F.lit(1)
    if not tiebreak:
        # all other columns order tied rows; rows equal in every column are
        # counted, and numbered again at the end
        tiebreak = [c for c in columns if c not in ("clientId", "timestamp")]
        gav_logs = gav_logs.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
        copy = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    rows = gav_logs.withColumn("bucket", idle_bucket(F.col("timestamp"), max_idle_ms))
    first_key = F.struct(*tiebreak)
    keys = ["clientId", "bucket", "timestamp"]
    # distinct (client, bucket, time), with the least tiebreak of each:
    # read by two branches, so kept once
    stamps = materialise(rows.groupBy(*keys).agg(F.min(first_key).alias("_first")))
    spans = stamps.groupBy("clientId", "bucket").agg(
        F.min("timestamp").alias("startTime"), F.max("timestamp").alias("endTime")
    )
    ids = bucket_sessions(spans, max_idle_ms).select("clientId", "bucket", "prevEnd", "sessionId")
    in_bucket = Window.partitionBy("clientId", "bucket").orderBy("timestamp")
    previous = stamps.join(ids, ["clientId", "bucket"]).select(
        "clientId",
        "timestamp",
        "sessionId",
        F.coalesce(F.lag("timestamp", 1).over(in_bucket), F.col("prevEnd")).alias("_prevDistinct"),
        "_first",
    )
    out = rows.join(previous, ["clientId", "timestamp"]).withColumn("_copy", copy)
    is_first = (first_key == F.col("_first")) & (F.col("_copy") == 1)
    out = out.withColumn("prev", F.when(is_first, F.col("_prevDistinct")).otherwise(F.col("timestamp")))
    diff = F.col("timestamp") - F.col("prev")
    return out.select(
        *columns,
        "prev",
        diff.alias("diff"),
        F.when(diff > F.lit(max_idle_ms), 1).otherwise(0).alias("isNewSession"),
        "sessionId",
    )


DAY_COLUMN = "startDay"


def with_start_day(sessions: DataFrame) -> DataFrame:
    """Adds ``startDay`` (UTC date of ``startTime``), the partition column of
    written session tables."""
    from depuse.functions.time import millis_to_day

    return sessions.withColumn(DAY_COLUMN, millis_to_day(F.col("startTime")))


def between(sessions: DataFrame, start_ms: int, end_ms: int, column: str = "startTime") -> DataFrame:
    """Half-open time range on session start: ``start <= startTime < end``.

    Plain comparisons on a long column, so the filter reaches the parquet
    scan as a pushed predicate.  When the table is partitioned by
    ``startDay`` the matching day range is added too, so only the folders of
    those days are listed and read (partition pruning).
    """
    if end_ms <= start_ms:
        return sessions.filter(F.lit(False))
    kept = sessions.filter((F.col(column) >= F.lit(start_ms)) & (F.col(column) < F.lit(end_ms)))
    if column == "startTime" and DAY_COLUMN in sessions.columns:
        import datetime as _dt

        first = _dt.datetime.fromtimestamp(start_ms / 1000, _dt.timezone.utc).date()
        last = _dt.datetime.fromtimestamp((end_ms - 1) / 1000, _dt.timezone.utc).date()
        kept = kept.filter((F.col(DAY_COLUMN) >= F.lit(first)) & (F.col(DAY_COLUMN) <= F.lit(last)))
    return kept


def session_gavs(sessions: DataFrame) -> DataFrame:
    """Long form ``clientId, sessionId, gav`` of sessions (one row per gav)."""
    return sessions.select("clientId", "sessionId", F.explode("gavs").alias("gav"))
