"""Structured log events on Spark: parsing, span pairing, querying, metrics and alerts."""
