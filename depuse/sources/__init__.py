"""Sources and sinks: text inputs, parquet tables, graph files, driver tables."""

from depuse.sources.tables import read_or_create, read_table, write_table
from depuse.sources.text import (
    dependency_record_rejects,
    parse_dependency_records,
    parse_repository_logs,
    read_adjacency,
    read_dependency_records,
    read_graph,
    read_repository_logs,
    repository_log_rejects,
)

__all__ = [
    "dependency_record_rejects",
    "parse_dependency_records",
    "parse_repository_logs",
    "read_adjacency",
    "read_dependency_records",
    "read_graph",
    "read_or_create",
    "read_repository_logs",
    "read_table",
    "repository_log_rejects",
    "write_table",
]
