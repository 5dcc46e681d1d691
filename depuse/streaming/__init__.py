"""Incremental gav resolution of arriving repository-log files."""

from depuse.streaming.ingest import resolve_stream, stream_repository_logs

__all__ = ["resolve_stream", "stream_repository_logs"]
