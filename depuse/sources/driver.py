"""The benchmark tables seen as the pipeline's inputs.

The driver tables hold no download logs, so fixed projections stand in:

* repository logs from ``events``: client = user, time = event time, agent =
  event type, path = ``artifacts/<props.k>.pom``;
* dependency records from ``part``: part ``k`` has gav ``org.part:p<k>`` and
  depends on parts ``k div 2`` and ``k div 3``; parts ending in 0 have the
  ``NO_DEPS`` sentinel (an acyclic graph).  The file of part ``k`` has key
  ``k + 10``, so downloads of keys 0 to 9 cannot be resolved;
* a cyclic graph from ``part``: in every 25 keys, place p -> (7p + 3) mod 25
  (cycles of up to 4), and from the first key of a block on to one of block / 2.

Rendering helpers turn the projections into text lines so the text parsers
run over every row; lines of events whose id is a multiple of 97 (and parts
whose key is) get an extra field, which makes them malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depuse.functions.sentinels import SENTINELS
from depuse.functions.time import epoch_millis

# Fixed values of the projection (shared with the SQL oracle).
PATH_PREFIX = "artifacts/"
PATH_SUFFIX = ".pom"
GAV_PREFIX = "org.part:p"
FIRST_FILE = 10
MALFORMED_EVERY = 97
DEFAULT_MAX_IDLE_MS = 43_200_000
NO_DEPS = SENTINELS[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _path_of(key: Column) -> Column:
    return F.concat(F.lit(PATH_PREFIX), key.cast("string"), F.lit(PATH_SUFFIX))


def _gav_of(key: Column) -> Column:
    return F.concat(F.lit(GAV_PREFIX), key.cast("string"))


def repository_logs(spark: SparkSession, sf_dir: str, with_event_id: bool = False) -> DataFrame:
    """``clientId, timestamp, agent, path`` (+ ``event_id`` for tie-breaking)."""
    events = table(spark, sf_dir, "events")
    cols = [
        F.col("user_id").cast("int").alias("clientId"),
        epoch_millis(F.col("ts")).alias("timestamp"),
        F.col("event_type").alias("agent"),
        _path_of(F.get_json_object("props", "$.k")).alias("path"),
    ]
    if with_event_id:
        cols.append(F.col("event_id"))
    return events.select(*cols)


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clientId, timestamp, agent, path`` of ``lineitem`` as downloads: a
    customer downloads the file of each part at the order's date.  Unlike the
    event logs, the number of artifacts grows with the scale."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        F.col("o_custkey").cast("int").alias("clientId"),
        epoch_millis(F.col("o_orderdate")).alias("timestamp"),
        F.lit("order").alias("agent"),
        _path_of(F.col("l_partkey") + FIRST_FILE).alias("path"),
    )


def repository_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text line per event, ``value`` column, as ``spark.read.text`` gives."""
    logs = repository_logs(spark, sf_dir, with_event_id=True)
    line = F.concat_ws(
        " ", F.col("clientId").cast("string"), F.col("timestamp").cast("string"), "agent", "path"
    )
    bad = F.col("event_id") % MALFORMED_EVERY == 0
    return logs.select(
        F.when(bad, F.concat(line, F.lit(" extra"))).otherwise(line).alias("value")
    )


def _part_dependencies(key: Column) -> Column:
    deps = F.array_distinct(F.array(_gav_of(F.floor(key / 2)), _gav_of(F.floor(key / 3))))
    return F.when(key % 10 == 0, F.array(F.lit(NO_DEPS))).otherwise(deps)


def all_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate edges of every part, sentinel or not (``src, dst``)."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        _gav_of(key).alias("src"),
        F.explode(F.array_distinct(F.array(_gav_of(F.floor(key / 2)), _gav_of(F.floor(key / 3))))).alias("dst"),
    )


def adjacency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One adjacency line ``<gav> <dep>,<dep>`` per part; every fifth has no
    dependencies, only its name."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    deps = F.array_distinct(F.array(_gav_of(F.floor(key / 2)), _gav_of(F.floor(key / 3))))
    listed = F.when(key % 5 != 4, F.array_join(deps, ","))
    return part.select(F.concat_ws(" ", _gav_of(key), listed).alias("value"))


def dependency_records(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    """``path, gav, dependencies`` of every part."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    cols = [
        _path_of(key + FIRST_FILE).alias("path"),
        _gav_of(key).alias("gav"),
        _part_dependencies(key).alias("dependencies"),
    ]
    if with_key:
        cols += [key, F.col("p_size"), F.col("p_name")]
    return part.select(*cols)


def dependency_record_lines(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    """One text line per part record: ``<p_size> <path> <gav> <deps>``;
    ``with_key`` adds ``p_partkey``."""
    records = dependency_records(spark, sf_dir, with_key=True)
    line = F.concat_ws(" ", F.col("p_size").cast("string"), "path", "gav", F.array_join("dependencies", ","))
    bad = F.col("p_partkey") % MALFORMED_EVERY == 0
    return records.select(
        F.when(bad, F.concat(line, F.lit(" extra"))).otherwise(line).alias("value"), *["p_partkey"] * with_key
    )


def records_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records keyed by part name: a record set whose paths repeat."""
    records = dependency_records(spark, sf_dir, with_key=True)
    return records.select(
        F.concat(F.lit("names/"), F.regexp_replace("p_name", " ", "-"), F.lit(PATH_SUFFIX)).alias("path"),
        "gav",
        "dependencies",
    )


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst`` of a graph of short cycles whose number grows with ``part``:
    every node is on a cycle, and blocks lead on to lower blocks."""
    part = table(spark, sf_dir, "part")
    key, place = F.col("p_partkey"), F.col("p_partkey") % 25
    ring = key - place + (place * 7 + 3) % 25
    on = F.when((place == 0) & (key >= 25), F.floor(F.floor(key / 25) / 2).cast("long") * 25 + 1)
    dst = F.explode(F.array_compact(F.array(ring, on)))
    return part.select(key.cast("string").alias("src"), dst.alias("dst")).withColumn("dst", F.col("dst").cast("string")).distinct()


def sentinel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with every sentinel case: part keys ending in 0 keep the lone
    ``NO_DEPS``, ending in 3 get both sentinels only, ending in 5 get
    ``UNKNOWN_DEPS`` after their real dependencies."""
    records = dependency_records(spark, sf_dir, with_key=True)
    last = F.col("p_partkey") % 10
    deps = F.col("dependencies")
    mixed = F.when(last == 3, F.array(F.lit(SENTINELS[1]), F.lit(SENTINELS[0]))).when(
        last == 5, F.concat(deps, F.array(F.lit(SENTINELS[0])))
    ).otherwise(deps)
    return records.select("path", "gav", mixed.alias("dependencies"))
