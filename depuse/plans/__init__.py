"""Composite jobs and the named queries over the benchmark tables."""
