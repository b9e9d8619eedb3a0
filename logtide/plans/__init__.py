"""Whole pipelines, and the registry of queries with their SQL counterparts."""
