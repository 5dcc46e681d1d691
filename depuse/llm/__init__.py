"""Operators of a training-data pipeline (filtering, near duplicates, PII,
mixing, packing, search, sharding).  Nothing else in the package imports this
one; ``queries.py`` holds the named queries and their SQL."""
