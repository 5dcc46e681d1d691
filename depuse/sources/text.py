"""Text sources: repository logs, dependency records, graph files.

Parsing is done with column expressions on ``spark.read.text`` so the work is
split like any file scan and stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depuse.functions.parsing import (
    LOG_LINE_PATTERN,
    RECORD_LINE_PATTERN,
    is_well_formed,
    log_fields,
    record_fields,
    split_dependencies,
)
from depuse.session import ensure_checkpoint_dir

# Graph file layout (pipe-delimited, with these headers).
GRAPH_DELIMITER = "|"
NODE_HEADER = ("id:ID", ":LABEL")
EDGE_HEADER = (":START_ID", ":END_ID", ":TYPE")
DIRECT_EDGE_TYPE = "D_DEPENDS_ON"
TRANSITIVE_EDGE_TYPE = "T_DEPENDS_ON"


def parse_repository_logs(lines: DataFrame, column: str = "value", on_overflow: str = "fail") -> DataFrame:
    """Lines -> ``clientId, timestamp, agent, path``; malformed lines dropped.

    ``on_overflow="fail"`` raises on a well-formed line whose number does not
    fit (the source behaviour); ``"reject"`` drops such lines instead.
    """
    line = F.col(column)
    parsed = lines.filter(is_well_formed(line, LOG_LINE_PATTERN)).select(*log_fields(line, on_overflow))
    if on_overflow == "reject":
        parsed = parsed.filter(F.col("clientId").isNotNull() & F.col("timestamp").isNotNull())
    return parsed


def repository_log_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that do not parse as repository logs (null and empty included)."""
    return lines.filter(~is_well_formed(F.col(column), LOG_LINE_PATTERN)).select(
        F.col(column).alias("line")
    )


def parse_dependency_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines -> ``path, gav, dependencies``; malformed lines dropped."""
    line = F.col(column)
    return lines.filter(is_well_formed(line, RECORD_LINE_PATTERN)).select(*record_fields(line))


def dependency_record_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that do not parse as dependency records."""
    return lines.filter(~is_well_formed(F.col(column), RECORD_LINE_PATTERN)).select(
        F.col(column).alias("line")
    )


def numbered_rejects(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``file, line_number, line`` of the lines that do not match ``pattern``.

    The files are read once.  A split's lines come in order, so a line's place
    in its split is the distance of its row id from the split's first; a split
    sends on one row with its number of lines and its rejects (at most what the
    split holds).  Running sums over the splits of a file, one small row each,
    give the lines before every split.  A line that crosses into the next split
    belongs to the one it starts in, as the reader has it.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    bad = F.when(~is_well_formed(F.col("value"), pattern), F.struct("at", F.col("value").alias("line")))
    splits = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"), F.collect_list(bad).alias("rejects")
    )
    ensure_checkpoint_dir(spark)
    splits = splits.checkpoint(eager=True)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "start", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    found = splits.select("file", "start", "first", F.explode("rejects").alias("reject")).join(before, ["file", "start"])
    number = F.col("before") + F.col("reject.at") - F.col("first") + 1
    return found.select("file", number.cast("long").alias("line_number"), F.col("reject.line").alias("line"))


def read_rejected_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_number, line`` of malformed repository log lines."""
    return numbered_rejects(spark, path, LOG_LINE_PATTERN)


def read_rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_number, line`` of malformed dependency record lines."""
    return numbered_rejects(spark, path, RECORD_LINE_PATTERN)


def read_repository_logs(spark: SparkSession, path: str, on_overflow: str = "fail") -> DataFrame:
    """Scan repository log text files (a path, directory or glob)."""
    return parse_repository_logs(spark.read.text(path), on_overflow=on_overflow)


def read_dependency_records(spark: SparkSession, path: str, require_unique_path: bool = True) -> DataFrame:
    """Scan dependency record text files.

    With ``require_unique_path`` (the resolver's use) a path occurring in two
    valid records raises, naming some of the duplicates.  The graph builder
    reads with ``False``: there repeated gavs union their dependencies.
    """
    records = parse_dependency_records(spark.read.text(path))
    if require_unique_path:
        from depuse.operators.quality import assert_unique_paths

        assert_unique_paths(records)
    return records


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Adjacency list ``gav dep1,dep2,...`` per line -> (nodes, edges)."""
    return parse_adjacency(spark.read.text(path))


def parse_adjacency(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Adjacency lines -> (nodes, edges).

    Nodes are every gav named on either side; edges are distinct.  Blank
    lines are skipped; a line without dependencies is a node of its own.
    """
    lines = lines.filter(F.length(F.trim(column)) > 0)
    parts = lines.select(F.split(F.trim(column), " ").alias("f"))
    rows = parts.select(
        F.element_at("f", 1).alias("src"),
        split_dependencies(F.coalesce(F.get("f", F.lit(1)), F.lit(""))).alias("deps"),
    )
    edges = rows.select("src", F.explode("deps").alias("dst")).distinct()
    nodes = (
        rows.select(F.col("src").alias("id"))
        .unionByName(edges.select(F.col("dst").alias("id")))
        .distinct()
    )
    return nodes, edges


def read_graph(
    spark: SparkSession, nodes_path: str, edges_path: str, edge_type: str = DIRECT_EDGE_TYPE
) -> tuple[DataFrame, DataFrame]:
    """Read pipe-delimited graph files written by ``operators.graph.write_graph``.

    Duplicate node ids are ignored (ids are unique afterwards).  Only edges of
    ``edge_type`` are returned; files with edges, but none of this type, raise.
    """
    nodes = (
        spark.read.csv(nodes_path, sep=GRAPH_DELIMITER, header=True, schema="id string, label string")
        .select("id")
        .dropDuplicates(["id"])
    )
    every = spark.read.csv(edges_path, sep=GRAPH_DELIMITER, header=True, schema="src string, dst string, type string")
    edges = every.filter(F.col("type") == edge_type)
    if edges.isEmpty() and not every.isEmpty():
        raise ValueError(f"{edges_path} holds no {edge_type} edges")
    return nodes, edges.select("src", "dst").distinct()
