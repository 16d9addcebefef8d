"""Operators of a training-data pipeline: deduplication, filters, extraction, mixing, formatting.

Nothing else in the package imports from here.  ``registry`` holds the queries and SQL.
"""
